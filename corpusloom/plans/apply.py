"""Job: assign clusters with a trained model and list each cluster's words.

``python -m corpusloom.plans.apply --documents IN --cluster MODEL --output1 OUT1 --output2 OUT2``
"""

from __future__ import annotations

from corpusloom.operators import clusters as cl
from corpusloom.plans import clustering as km
from corpusloom.plans.train import arguments, read_corpus
from corpusloom.session import build_session, discard, stage
from corpusloom.sources.files import write_lines


def main(argv: list[str] | None = None) -> None:
    args = arguments(__doc__)
    args.add_argument("-i", "--cluster", required=True, help="model folder")
    args.add_argument("--output1", required=True, help="folder for cluster and document id")
    args.add_argument("--output2", required=True, help="folder for top words per cluster")
    args.add_argument("--top", type=int, default=cl.TOP_WORDS)
    args.add_argument("--predict-space", choices=("tfidf", "tf"), default="tfidf")
    args.add_argument("--one-file", action="store_true", help="one result file per output")
    given = args.parse_args(argv)
    spark = build_session("apply", given.master)
    docs = read_corpus(spark, given.documents, given.where, given.profiles, given.languages.split(","))
    model = km.load(given.cluster)
    assigned = stage(km.assign(model, km.document_tokens(docs), given.predict_space), "assignment")
    write_lines(cl.assignment_lines(assigned), given.output1, given.one_file)
    top = cl.top_words(cl.words_of_assigned(assigned), given.top)
    write_lines(cl.top_words_lines(top), given.output2, given.one_file)
    discard(assigned)


if __name__ == "__main__":
    main()
