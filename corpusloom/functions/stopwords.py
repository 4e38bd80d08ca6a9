"""Stop words by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The English and French lists that Spark ships for
# StopWordsRemover, and the 33 words of the common standard analyser, which
# serves every language without a list of its own.
ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what which
who whom this that these those am is are was were be been being have has had having do
does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will
just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't
wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split()

FRENCH = """
au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me
même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te
tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant
étante étants étantes suis es est sommes êtes sont serai seras sera serons serez seront
serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes
fûtes furent sois soit soyons soyez soient fusse fusses fût fussions fussiez fussent
ayant ayante ayantes ayants eu eue eues eus ai as avons avez ont aurai auras aura aurons
aurez auront aurais aurait aurions auriez auraient avais avait avions aviez avaient eut
eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez
eussent
""".split()

STANDARD = """
a an and are as at be but by for if in into is it no not of on or such that the their
then there these they this to was will with
""".split()

DEFAULTS: dict[str, list[str]] = {"en": ENGLISH, "fr": FRENCH}


def read_stopword_file(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """Read a word-list file in which ``|`` starts a comment.

    Returns distinct ``(lang, word)`` rows; a line may hold several words.
    """
    before_comment = F.substring_index("value", "|", 1)
    words = F.split(F.lower(F.trim(F.regexp_replace(before_comment, r"\s+", " "))), " ")
    return (
        spark.read.text(path)
        .select(F.lit(lang).alias("lang"), F.explode(words).alias("word"))
        .where(F.col("word") != "")
        .distinct()
    )
