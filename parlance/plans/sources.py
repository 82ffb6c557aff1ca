"""Input tables of the jobs, derived from the driver's tables.

The reference reads TSV files; here the same line formats are built from
the parquet tables (FIXTURES.md §2) and parsed by the same parsers a TSV
``spark.read.text`` scan would go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources import lines as L
from parlance.sources import tables as TB

# Fixed values of the inline fixtures (FIXTURES.md §3).
SLOT_DICTIONARY_LINES = [
    ("quantifier", 1, "that,that"),
    ("quantifier", 1, "this,this"),
    ("preposition", 2, "with,with"),
    ("preposition", 2, "from,from"),
    ("preposition", 2, "of,of the,of"),
]
LEMMA_PAIRS = [("was", "be"), ("is", "be"), ("were", "be")]
# Pairs that suffix rules are learned from, token:lemma.
INFLECTIONS = """
walked:walk talked:talk played:play called:call opened:open showed:show turned:turn rained:rain
liked:like moved:move closed:close named:name tried:try carried:carry studied:study stopped:stop planned:plan
walking:walk talking:talk playing:play calling:call opening:open showing:show turning:turn raining:rain
making:make moving:move closing:close taking:take running:run stopping:stop planning:plan sitting:sit
players:player teams:team games:game scores:score clouds:cloud storms:storm days:day weeks:week
cities:city stories:story parties:party countries:country boxes:box buses:bus wishes:wish glasses:glass
runs:run plays:play calls:call tries:try carries:carry goes:go does:do
wives:wife knives:knife leaves:leaf halves:half
colder:cold warmer:warm faster:fast higher:high coldest:cold warmest:warm fastest:fast highest:high
this:this his:his thing:thing king:king bring:bring bed:bed red:red glass:glass process:process
""".split()


SCAN_PARTITIONS = "spark.parlance.scanPartitions"


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt over the number of partitions that the session asks for.

    Off unless the session sets it: the test tables are one row group each,
    which no split size can divide; real tables have many.
    """
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, "")
    return df.repartition(int(n)) if n else df


def documents(spark: SparkSession, sf_dir: str, cols=("doc_id", "text", "lang")) -> DataFrame:
    return dealt(TB.read_table(spark, sf_dir, "documents").select(*cols))


def intent_label(quality, toxic):
    return (F.when(toxic == 1, F.lit("toxic")).when(quality == 1, F.lit("quality"))
            .when(quality.isNotNull(), F.lit("Other")))


def intent_lines(spark: SparkSession, sf_dir: str, labelled: bool = False) -> DataFrame:
    """{line_id, domain, value}: ``text<TAB>intent`` per document; unlabelled
    documents give a one-field line (dropped by the intent reader), or none
    with ``labelled``, before any text is touched."""
    docs = documents(spark, sf_dir)
    labels = TB.read_table(spark, sf_dir, "labels")
    lab = intent_label(F.col("quality"), F.col("toxic"))
    j = docs.join(labels.where(lab.isNotNull()), "doc_id") if labelled else docs.join(labels, "doc_id", "left")
    return j.select(F.col("doc_id").alias("line_id"), domain_of_lang(F.col("lang")).alias("domain"),
                    F.concat_ws("\t", TB.one_line(F.col("text")), lab).alias("value"))


def intent_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``intent_lines`` with a constant for the text, where only labels are wanted."""
    docs = TB.read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    j = docs.join(TB.read_table(spark, sf_dir, "labels"), "doc_id", "left")
    lab = intent_label(F.col("quality"), F.col("toxic"))
    return j.select(F.col("doc_id").alias("line_id"), domain_of_lang(F.col("lang")).alias("domain"),
                    F.concat_ws("\t", F.lit("-"), lab).alias("value"))


def domain_of_lang(lang):
    return F.when(lang == "en", F.lit("nba")).otherwise(F.lit("weather"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{conv_id, turn, utterance, previousTask, strLabel, domain} (S3)."""
    conv = TB.read_table(spark, sf_dir, "conversations")
    return L.parse_turns(TB.turn_lines(conv), keep=("conv_id", "turn"))


def turn_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{conv_id, turn, strLabel, domain}: what the running prior needs, in one scan without text."""
    conv = TB.read_table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", F.col("role").alias("strLabel"), TB.turn_domain(F.col("conv_id")).alias("domain"))


def turn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``turns`` without the utterance: straight from the table's columns, so no text is read."""
    from parlance.operators.context import previous_task

    conv = TB.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    prev = previous_task(conv, ["conv_id"], ["turn"], "role", out_col="previousTask")
    return prev.select("conv_id", "turn", "previousTask", F.col("role").alias("strLabel"),
                       TB.turn_domain(F.col("conv_id")).alias("domain"))


def slot_dictionary(spark: SparkSession) -> DataFrame:
    lines = spark.createDataFrame(SLOT_DICTIONARY_LINES, "slot string, slot_order int, value string")
    return L.parse_dictionary(lines)


def lemma_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEMMA_PAIRS, "token string, lemma string")


def inflections(spark: SparkSession) -> DataFrame:
    """{token, lemma}: the inline pairs that suffix rules are learned from."""
    return spark.createDataFrame([tuple(x.split(":")) for x in INFLECTIONS], "token string, lemma string")


def product_dictionary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary lines from ``part``: ``brand,name,type`` (canonical = brand)."""
    part = TB.read_table(spark, sf_dir, "part")
    return part.select(F.lit("product").alias("slot"), F.lit(1).alias("slot_order"),
                       F.concat_ws(",", "p_brand", "p_name", "p_type").alias("value"))


def rule_language(text) -> F.Column:
    """A fixed rule guessing the language from stop words (pseudo predictions
    with a class that is only predicted: ``xx``)."""
    t = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return (F.when(t.contains(" the "), F.lit("en"))
            .when(t.contains(" der ") | t.contains(" die "), F.lit("de"))
            .when(t.contains(" el ") | t.contains(" los "), F.lit("es"))
            .when(t.contains(" le ") | t.contains(" les "), F.lit("fr"))
            .otherwise(F.lit("xx")))


def pseudo_scores(docs: DataFrame) -> DataFrame:
    """{doc_id, domain, classifier, score}: deterministic scores in [0, 1]
    with 3 decimals, four classifiers over two domains."""
    specs = [("nba", "intentA", 13), ("nba", "intentB", 29),
             ("weather", "intentC", 41), ("weather", "intentD", 53)]
    entries = [F.struct(F.lit(d).alias("domain"), F.lit(c).alias("classifier"),
                        F.round(F.pmod(F.length("text") * m + F.col("doc_id"), F.lit(997)) / 996.0, 3)
                        .cast("double").alias("score"))
               for d, c, m in specs]
    return docs.select("doc_id", F.inline_outer(F.array(*entries)))
