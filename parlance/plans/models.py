"""Model jobs: training (M1-M7), the model store (K1, S9, S10) and scoring
(C1-C7).

Training jobs fit anew on every call, save the models in the store and
evaluate them; scoring and streaming jobs score with models loaded from the
store, which are trained first only where the store has none for the tables
as they are.  Fitted floats cannot be matched by SQL, so the registered jobs
return what is fixed by the data -- labels, keys, row counts -- next to proofs
computed from the fitted results: of a linear model that the gradient of its
objective vanishes at its coefficients, of a forest that its leaves hold the
training rows that fall into them, and of every score that it follows from the
coefficients by another way of computing it.  A model with other coefficients
fails them.  The functions that the jobs call return the numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import context as CX
from parlance.operators import evaluate as EV
from parlance.operators import features as FE
from parlance.operators import forest as FO
from parlance.operators import labels as LB
from parlance.operators import linear as LN
from parlance.operators import scoring as SC
from parlance.operators import slots as SL
from parlance.operators import split as SP
from parlance.operators import store as ST
from parlance.operators import train as TR
from parlance.operators.features import DOMAIN_FEATURES, INTENT_FEATURES
from parlance.plans import sources as S
from parlance.plans.jobs import _INTENT_ROWS, _TURNS, job
from parlance.session import scratch_path
from parlance.sources import files as FL
from parlance.sources import lines as L
from parlance.sources import tables as TB

# ---------------------------------------------------------------- store places
MODEL_TABLES = ("documents", "labels", "conversations", "embeddings")


def table_state(spark: SparkSession, sf: str) -> str:
    """Digest of the model tables' folders or files (path, bytes, files, time of change): a changed table is another state.

    Two calls per table to the storage layer; no file is listed here and no row is read.
    """
    found = []
    for name in MODEL_TABLES:
        fs, at = ST._fs(spark, f"{sf}/{name}.parquet")
        size, status = fs.getContentSummary(at), fs.getFileStatus(at)
        found.append((status.getPath().toString(), size.getLength(), size.getFileCount(), status.getModificationTime()))
    return hashlib.sha256(repr(found).encode()).hexdigest()[:16]


def model_root(spark: SparkSession, sf: str, name: str) -> str:
    return scratch_path(spark, "models", table_state(spark, sf), name, unique=False)


def kept_folder(spark: SparkSession, sf: str, name: str, build) -> str:
    """Folder of a derived table that several fits read: written and published once per state of the tables.

    A write that dies half-way is never published, so it is neither read nor in the way.
    """
    root = scratch_path(spark, "frames", table_state(spark, sf), name, unique=False)
    return ST.current(spark, root) or ST.publish(spark, root, lambda folder: build().write.parquet(folder))


def kept_table(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    return spark.read.parquet(kept_folder(spark, sf, name, build))


def _stored(spark: SparkSession, sf: str, name: str, train) -> str:
    """Root of a set of models that has been trained: trained and saved first if nothing is published."""
    root = model_root(spark, sf, name)
    if ST.current(spark, root) is None:
        ST.save_models(spark, train(spark, sf), root)
    return root


def trained(spark: SparkSession, sf: str, name: str, train, domain: str | None = None,
            kind: str | None = None) -> list[TR.TextModel]:
    """The pipeline models of one set, loaded from the store."""
    return ST.load_models(spark, _stored(spark, sf, name, train), domain, kind)


def trained_linear(spark: SparkSession, sf: str, name: str, train, domain: str | None = None) -> LN.LinearSet:
    """The linear models of one set, loaded from the store."""
    return ST.load_linear(spark, _stored(spark, sf, name, train), domain)


def train_and_save(spark: SparkSession, sf: str, name: str, train) -> list:
    """Fits the models anew and publishes them as the set's next version."""
    models = train(spark, sf)
    ST.save_models(spark, models, model_root(spark, sf, name))
    return models


# ---------------------------------------------------------------- inputs
def domain_rows(spark, sf) -> DataFrame:
    """{line_id, utterance, strLabel, is_train} from ``text<TAB>lang`` lines."""
    rows = L.parse_utterances(TB.utterance_lines(S.documents(spark, sf)), min_fields=1, trim_text=False,
                              keep=("line_id",))
    return SP.hash_split(rows, "line_id")


def slot_text(spark, df: DataFrame, text_col: str = "utterance", out_col: str = "utterance_slots") -> DataFrame:
    pats = SL.slot_patterns(S.slot_dictionary(spark))
    return SL.replace_slots(df, text_col, pats, out_text=out_col, out_count="_n_slots").drop("_n_slots")


def intent_rows(spark, sf) -> DataFrame:
    """{line_id, domain, utterance, strLabel, utterance_slots}."""
    rows = L.parse_utterances(S.intent_lines(spark, sf, labelled=True), min_fields=2, keep=("line_id", "domain"))
    return slot_text(spark, rows)


#: Which text a domain's models read: slot-replaced where the domain has dictionaries.
TEXT_FOR = {"nba": "utterance_slots", "weather": "utterance"}


def domain_frame(spark, sf) -> DataFrame:
    """{line_id, strLabel, is_train, features}: the documents featurised once (hashed bigrams, width 5000)."""
    return kept_table(spark, sf, "domain", lambda: TR.featurize_text(
        domain_rows(spark, sf), "utterance", DOMAIN_FEATURES).select("line_id", "strLabel", "is_train", "features"))


def intent_frame(spark, sf) -> DataFrame:
    """{line_id, domain, strLabel, is_train, features}: labelled texts of both domains featurised once."""
    def build():
        rows = SP.hash_split(intent_rows(spark, sf), "line_id")
        text = F.lit(None).cast("string")
        for domain, col in TEXT_FOR.items():
            text = F.when(F.col("domain") == domain, F.col(col)).otherwise(text)
        rows = rows.select("line_id", "domain", "strLabel", "is_train", text.alias("utterance"))
        return TR.featurize_text(rows, "utterance", INTENT_FEATURES).drop("utterance")
    return kept_table(spark, sf, "intents", build)


# ---------------------------------------------------------------- training
def train_domain(algo: str = "lr", **params):
    """M1 / M4 / M7: one language model over all documents."""
    def train(spark, sf) -> list[TR.TextModel]:
        f = domain_frame(spark, sf)
        m = TR.train_on_features(f.filter("is_train"), f, algo=algo, num_features=DOMAIN_FEATURES, **params)
        return [TR.TextModel("lang", "langDomain", "domain", m, TR.model_labels(m), DOMAIN_FEATURES)]
    return train


def fit_rows(frame: DataFrame, group: str | None = None) -> DataFrame:
    """{features, label, group} rows for ``operators.linear``."""
    g = F.col(group) if group else F.lit(None).cast("string")
    return frame.select("features", F.col("strLabel").alias("label"), g.alias("group"))


def intent_keys(spark, sf) -> LN.Keys:
    """All (domain, intent) models: an intent against ``Other`` within its domain."""
    frame = intent_frame(spark, sf)
    found = (frame.select("domain", F.col("strLabel").alias("key")).distinct().where(F.col("key") != LB.OTHER)
             .orderBy("domain", "key").collect())  # a row per model
    return LN.Keys(tuple(r["key"] for r in found), tuple(r["domain"] for r in found), LB.OTHER)


def language_keys(spark, sf) -> LN.Keys:
    """A model per language, against all other rows."""
    keys = sorted(r[0] for r in LB.label_keys(domain_frame(spark, sf)).collect())  # one model each
    return LN.Keys(tuple(keys), (None,) * len(keys))


def train_intents(spark, sf) -> list[LN.LinearSet]:
    """M2: the binary LRs of all intents of both domains, in one fit."""
    rows = fit_rows(intent_frame(spark, sf).filter("is_train"), "domain")
    return [LN.fit(rows, intent_keys(spark, sf), INTENT_FEATURES, TR.LR_REG)[0]]


def train_one_vs_rest(spark, sf) -> list[LN.LinearSet]:
    """M3: the binary LRs of all languages vs all the rest, in one fit."""
    rows, keys = fit_rows(domain_frame(spark, sf).filter("is_train")), language_keys(spark, sf)
    return [LN.fit(rows, keys, DOMAIN_FEATURES, TR.LR_REG, domains=["lang"] * len(keys.labels))[0]]


def domain_model(spark, sf) -> TR.TextModel:
    return trained(spark, sf, "domain-lr", train_domain())[0]


def intent_models(spark, sf, domain: str | None = None) -> LN.LinearSet:
    return trained_linear(spark, sf, "intents", train_intents, domain)


def one_vs_rest_models(spark, sf) -> LN.LinearSet:
    return trained_linear(spark, sf, "one-vs-rest", train_one_vs_rest)


# ---------------------------------------------------------------- proofs
#: Largest gradient of a fit, as a share of that at zero coefficients.
CONVERGED = 1e-4


def _lr(tm: TR.TextModel):
    return SC._split_stages(tm.model)[1][0]


def domain_residuals(spark, sf, labels: list[str], coefficients: np.ndarray, intercepts: np.ndarray,
                     one_vs_rest: bool) -> dict[str, float]:
    """Per label the residual of a language model: one for all classes together, or one per class against the rest."""
    rows = fit_rows(domain_frame(spark, sf).filter("is_train"))
    if one_vs_rest:
        models = LN.LinearSet(("lang",) * len(labels), tuple(labels), coefficients, intercepts)
        return dict(zip(labels, LN.residuals(rows, LN.Keys(tuple(labels), (None,) * len(labels)), models, TR.LR_REG).tolist(),
                        strict=True))
    if len(labels) == 2 and len(coefficients) == 1:
        models = LN.LinearSet(("lang",), (labels[1],), coefficients, intercepts)
        r = LN.residuals(rows, LN.Keys((labels[1],), (None,)), models, TR.LR_REG)[0]
    else:
        r = LN.softmax_residual(rows, labels, coefficients, intercepts, TR.LR_REG)
    return dict.fromkeys(labels, float(r))


#: Largest deviation of a leaf's weight from its rows, in standard deviations of the bootstrap.
LEAF_DEVIATIONS = 8.0


def forest_deviation(spark, rows: DataFrame, forest) -> float:
    """``forest.leaf_deviation`` of a fitted forest on its training rows {features, label}."""
    trees = FO.read_trees(spark, forest)
    return FO.leaf_deviation(FO.leaf_counts(rows, trees), trees)


def _is_small(residuals: dict[str, float], key: Column, most: float) -> Column:
    """Whether the key's residual is at most ``most`` (residuals are one number per model)."""
    good = [k for k, r in residuals.items() if r <= most]
    return key.isin(good) if good else F.lit(False)


def same_scores(scored: DataFrame, again: DataFrame, keys: list[str], ok: str = "ok") -> DataFrame:
    """``scored`` (keys..., score) with ``ok``: its score is that of ``again``."""
    other = again.select(*keys, F.col("score").alias("_again"))
    return scored.join(other, keys, "left").withColumn(
        ok, F.coalesce(F.abs(F.col("score") - F.col("_again")) < 1e-9, F.lit(False))).drop("_again")


def scores_by_join(texts: DataFrame, models: LN.LinearSet, id_col: str, text_for: dict[str, str] | str = "utterance") -> DataFrame:
    """{id, domain, classifier, score} of a set, from hashed TF joined with the coefficients, domain by domain."""
    out = None
    for d in sorted(set(models.domains)):
        part = LN.subset(models, [i for i, x in enumerate(models.domains) if x == d])
        col = text_for.get(d, "utterance") if isinstance(text_for, dict) else text_for
        one = SC.score_lr_by_join(texts, FE.hashed_tf(texts, id_col, col, models.width), id_col, part)
        out = one if out is None else out.unionByName(one)
    return out


def class_by_join(texts: DataFrame, id_col: str, labels: list[str], coefficients: np.ndarray, intercepts: np.ndarray,
                  width: int, text_col: str = "utterance") -> DataFrame:
    """{id, label, p}: the class of the greatest margin and its softmax share, from hashed TF joined with coefficients."""
    if len(coefficients) == 1:  # a binary model: the margin of the second class over the first
        coefficients, intercepts = np.stack([0 * coefficients[0], coefficients[0]]), np.array([0.0, intercepts[0]])
    m = SC.margins_by_join(texts, FE.hashed_tf(texts, id_col, text_col, width), id_col, coefficients, intercepts)
    top = F.max(F.struct("margin", (-F.col("place")).alias("_p")))
    per = m.groupBy(id_col).agg(top.alias("_top"), F.collect_list("margin").alias("_all"))  # a margin per class
    share = 1 / F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top.margin")))
    names = F.array(*[F.lit(x) for x in labels])
    return per.select(id_col, F.get(names, (-F.col("_top._p")).cast("int")).alias("label"), share.alias("p"))


# ---------------------------------------------------------------- evaluation
def _label_index(labels, col: str = "strLabel") -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(col)) - 1).cast("double")


def evaluate_model(tm: TR.TextModel, test: DataFrame) -> DataFrame:
    """A4-A6 per label of a model on rows with ``features``; the label's name as ``value``."""
    _, rest = SC._split_stages(tm.model)
    out = PipelineModel(stages=rest).transform(test).withColumn("label", _label_index(tm.labels))
    per = EV.metrics_by_label(out)
    return per.withColumn("value", F.get(F.array(*[F.lit(x) for x in tm.labels]), F.col("label").cast("int")))


def evaluate_keys(models: LN.LinearSet, test: DataFrame, negatives: str | None) -> DataFrame:
    """Metrics summary per (domain, classifier), all models applied to the test rows in one pass."""
    rows = test if "domain" in test.columns else test.withColumn("domain", F.lit(None).cast("string"))
    rows = rows.withColumnsRenamed({"domain": "_of"}).withColumn("_row", F.monotonically_increasing_id())
    scored = SC.classify_linear(rows, models, ["_row", "_of", "strLabel"], features="features")
    label = F.col("strLabel")
    if negatives:
        scored = scored.where((F.col("domain") == F.col("_of")) & ((label == F.col("classifier")) | (label == negatives)))
    pairs = scored.select("domain", "classifier", F.when(label == F.col("classifier"), 1.0).otherwise(0.0).alias("label"),
                          F.when(F.col("predictedLabel") == F.col("classifier"), 1.0).otherwise(0.0).alias("prediction"))
    return EV.metrics_summary(pairs, by=["domain", "classifier"])


def _metrics_ok() -> Column:
    """Counts and rates of ``metrics_by_label`` hold together."""
    return ((F.col("tp") >= 0) & (F.col("tp") <= F.col("n_label")) & (F.col("fp") >= 0)
            & F.col("precision").between(0, 1) & F.col("f1").between(0, 1)
            & (F.abs(F.col("recall") - F.col("tp") / F.col("n_label")) < 1e-9))


def _summary_ok() -> Column:
    return (F.col("accuracy").between(0, 1) & (F.abs(F.col("accuracy") + F.col("test_error") - 1) < 1e-9)
            & F.col("weighted_precision").between(0, 1) & F.col("weighted_f1").between(0, 1))


def evaluate_domain(spark, sf, name: str, train) -> DataFrame:
    tm = train_and_save(spark, sf, name, train)[0]
    return evaluate_model(tm, domain_frame(spark, sf).filter(~F.col("is_train")))


def _proved_domain(spark, sf, name: str, train, one_vs_rest: bool = False) -> DataFrame:
    """Test metrics per label of a linear language model; ``ok`` only if its fit is one."""
    tm = train_and_save(spark, sf, name, train)[0]
    per = evaluate_model(tm, domain_frame(spark, sf).filter(~F.col("is_train")))
    found = domain_residuals(spark, sf, tm.labels, *SC.linear_form(_lr(tm)), one_vs_rest)
    return _domain_result(per, _is_small(found, F.col("value"), CONVERGED))


_SPLIT = "((('0x' || substr(md5(CAST({k} AS VARCHAR) || ':11'), 1, 8))::BIGINT) % 100)"
_DOMAIN_TEST = f"""
SELECT lang AS label, count(*) AS n_label, true AS ok FROM documents
WHERE {_SPLIT.format(k='doc_id')} >= 80 GROUP BY lang"""


def _domain_result(per: DataFrame, proved: Column) -> DataFrame:
    return per.select(F.col("value").alias("label"), "n_label", (_metrics_ok() & proved).alias("ok"))


@job("q_train_domain", _DOMAIN_TEST)
def q_train_domain(spark, sf):
    """M1: LR on hashed bigrams, evaluated per label on the test split; ok: the gradient vanishes at its coefficients."""
    return _proved_domain(spark, sf, "domain-lr", train_domain())


@job("q_train_ovr_lr", _DOMAIN_TEST)
def q_train_ovr_lr(spark, sf):
    """M4: OneVsRest(LR), evaluated per label on the test split; ok: the class's gradient vanishes."""
    return _proved_domain(spark, sf, "domain-ovr", train_domain("ovr_lr"), one_vs_rest=True)


@job("q_train_forest", _DOMAIN_TEST)
def q_train_forest(spark, sf):
    """M7: random forest (500 trees, depth 5) on hashed bigrams; ok: its leaves hold the training rows that fall into them."""
    train = train_domain("rf", num_trees=TR.FOREST_TREES, maxDepth=TR.FOREST_DEPTH)
    tm = train_and_save(spark, sf, "domain-forest", train)[0]
    per = evaluate_model(tm, domain_frame(spark, sf).filter(~F.col("is_train")))
    rows = domain_frame(spark, sf).filter("is_train").select("features", _label_index(tm.labels).alias("label"))
    return _domain_result(per, F.lit(forest_deviation(spark, rows, _lr(tm)) <= LEAF_DEVIATIONS))


def evaluate_intents(spark, sf) -> DataFrame:
    models = train_and_save(spark, sf, "intents", train_intents)[0]
    return evaluate_keys(models, intent_frame(spark, sf).filter(~F.col("is_train")), LB.OTHER)


def intent_residuals(spark, sf, models: LN.LinearSet) -> dict[str, float]:
    """Residual by "domain/intent"."""
    rows, keys = fit_rows(intent_frame(spark, sf).filter("is_train"), "domain"), intent_keys(spark, sf)
    found = LN.residuals(rows, keys, models, TR.LR_REG).tolist()
    return {f"{d}/{k}": r for d, k, r in zip(keys.groups, keys.labels, found, strict=True)}


def language_residuals(spark, sf, models: LN.LinearSet) -> dict[str, float]:
    """Residual by "lang/language"."""
    keys = language_keys(spark, sf)
    found = LN.residuals(fit_rows(domain_frame(spark, sf).filter("is_train")), keys, models, TR.LR_REG).tolist()
    return {f"lang/{k}": r for k, r in zip(keys.labels, found, strict=True)}


def _proved_keys(per: DataFrame, residuals: dict[str, float]) -> DataFrame:
    small = _is_small(residuals, F.concat_ws("/", "domain", "classifier"), CONVERGED)
    return per.select("domain", "classifier", "n", (_summary_ok() & small).alias("ok"))


@job("q_train_intents", f"""
WITH r AS ({_INTENT_ROWS}), k AS (SELECT DISTINCT domain, strLabel AS key FROM r WHERE strLabel <> 'Other')
SELECT k.domain, k.key AS classifier, count(*) AS n, true AS ok
FROM k JOIN r ON r.domain = k.domain AND r.strLabel IN (k.key, 'Other')
WHERE {_SPLIT.format(k='line_id')} >= 80 GROUP BY k.domain, k.key""")
def q_train_intents(spark, sf):
    """M2: one row of test metrics per (domain, intent) model; ok: its gradient vanishes at its coefficients."""
    per = evaluate_intents(spark, sf)
    return _proved_keys(per, intent_residuals(spark, sf, intent_models(spark, sf)))


def evaluate_one_vs_rest(spark, sf) -> DataFrame:
    models = train_and_save(spark, sf, "one-vs-rest", train_one_vs_rest)[0]
    return evaluate_keys(models, domain_frame(spark, sf).filter(~F.col("is_train")), None)


@job("q_train_one_vs_rest", f"""
WITH k AS (SELECT DISTINCT lang AS key FROM documents)
SELECT 'lang' AS domain, k.key AS classifier, count(*) AS n, true AS ok FROM k, documents
WHERE {_SPLIT.format(k='doc_id')} >= 80 GROUP BY k.key""")
def q_train_one_vs_rest(spark, sf):
    """M3: one row of test metrics per language-vs-rest model; ok: its gradient vanishes at its coefficients."""
    per = evaluate_one_vs_rest(spark, sf)
    return _proved_keys(per, language_residuals(spark, sf, one_vs_rest_models(spark, sf)))


def embeddings(spark, sf) -> DataFrame:
    return SP.hash_split(TB.read_table(spark, sf, "embeddings"), "vec_id")


def train_perceptron(spark, sf) -> list[TR.TextModel]:
    """M6, classes counted on all rows."""
    emb = embeddings(spark, sf)
    n = int(emb.agg(F.max("label")).first()[0]) + 1
    m = TR.train_mlp(emb.filter("is_train"), n_classes=n)
    return [TR.TextModel("embeddings", "perceptron", "vector", m, [str(i) for i in range(n)], 0)]


def _perceptron_rows(tm: TR.TextModel, rows: DataFrame) -> DataFrame:
    return tm.model.transform(TR.mlp_input(rows)).withColumn("label", F.col("label").cast("double"))


def evaluate_perceptron(spark, sf) -> DataFrame:
    tm = train_and_save(spark, sf, "perceptron", train_perceptron)[0]
    return EV.metrics_summary(_perceptron_rows(tm, embeddings(spark, sf).filter(~F.col("is_train"))))


@job("q_train_mlp", f"SELECT count(*) AS n, true AS ok FROM embeddings WHERE {_SPLIT.format(k='vec_id')} >= 80")
def q_train_mlp(spark, sf):
    """M6: perceptron on the embeddings, summary metrics on the test split; ok: on its training rows it beats always naming
    the commonest label."""
    per = evaluate_perceptron(spark, sf)
    fitted = perceptron_statistics(spark, sf).agg((F.sum("tp") > F.max("n_label")).alias("fitted")).scalar()
    return per.select("n", (_summary_ok() & fitted).alias("ok"))


def perceptron_statistics(spark, sf) -> DataFrame:
    """A10: per-label statistics of the network on its training rows (as the reference)."""
    tm = trained(spark, sf, "perceptron", train_perceptron)[0]
    return EV.metrics_by_label(_perceptron_rows(tm, embeddings(spark, sf).filter("is_train")))


@job("q_mlp_eval", f"""
SELECT CAST(label AS DOUBLE) AS label, count(*) AS n_label, true AS ok, true AS above_majority
FROM embeddings WHERE {_SPLIT.format(k='vec_id')} < 80 GROUP BY label""")
def q_mlp_eval(spark, sf):
    """A10; ``above_majority``: on its training rows the network beats always naming the commonest label."""
    per = perceptron_statistics(spark, sf)
    share = per.agg((F.sum("tp") > F.max("n_label")).alias("above_majority"))  # one row
    return per.select("label", "n_label", _metrics_ok().alias("ok")).withColumn("above_majority", share.scalar())


# ---------------------------------------------------------------- registry / save / load
_REGISTRY_SQL = f"""
SELECT DISTINCT domain, strLabel AS classifier, 'intent' AS kind FROM ({_INTENT_ROWS}) WHERE strLabel <> 'Other'
UNION ALL SELECT DISTINCT domain, domain || 'Domain' AS classifier, 'domain' AS kind FROM ({_INTENT_ROWS})"""


def model_registry(rows: DataFrame, domain_col: str = "domain", label_col: str = "strLabel") -> DataFrame:
    """{domain, classifier, kind} of the models a labelled set yields."""
    intents = (rows.filter(F.col(label_col) != LB.OTHER)
               .select(domain_col, F.col(label_col).alias("classifier")).distinct()
               .withColumn("kind", F.lit("intent")))
    domains = (rows.select(domain_col).distinct()
               .select(domain_col, F.concat(F.col(domain_col), F.lit("Domain")).alias("classifier"),
                       F.lit("domain").alias("kind")))
    return intents.unionByName(domains)


@job("q_model_registry", _REGISTRY_SQL)
def q_model_registry(spark, sf):
    rows = L.parse_utterances(S.intent_label_lines(spark, sf), min_fields=2, keep=("line_id", "domain"))
    return model_registry(rows)


def benchmark_texts(spark, sf) -> DataFrame:
    return S.dealt(TB.read_table(spark, sf, "benchmark")).select("item_id", F.col("text").alias("utterance"))


_INTENT_KEYS = f"SELECT DISTINCT domain, strLabel AS classifier FROM ({_INTENT_ROWS}) WHERE strLabel <> 'Other'"
_ALL_MODELS = f"SELECT 'lang' AS domain, 'langDomain' AS classifier UNION ALL {_INTENT_KEYS}"


@job("q_model_roundtrip", f"SELECT item_id, domain, classifier, true AS same FROM benchmark, ({_ALL_MODELS})")
def q_model_roundtrip(spark, sf):
    """Train, save, load, and score the benchmark texts with both copies of all models."""
    domain, intents = train_domain()(spark, sf), train_intents(spark, sf)[0]
    root = scratch_path(spark, "models", "roundtrip")
    ST.save_models(spark, [*domain, intents], root)
    b = slot_text(spark, benchmark_texts(spark, sf))
    keys = ["item_id", "domain", "classifier"]

    def scored(pipelines, linear) -> DataFrame:
        return SC.classify_all(b, pipelines, "item_id").unionByName(SC.classify_all(b, linear, "item_id", TEXT_FOR))

    both = scored(domain, intents).join(
        scored(ST.load_models(spark, root), ST.load_linear(spark, root)).select(
            *keys, F.col("predictedLabel").alias("again"), F.col("score").alias("score_again")), keys)
    return both.select(*keys, ((F.col("predictedLabel") == F.col("again"))
                               & (F.abs(F.col("score") - F.col("score_again")) < 1e-12)).alias("same"))


# ---------------------------------------------------------------- scoring
def classify_checked(texts: DataFrame, tm: TR.TextModel, coefficients: np.ndarray, intercepts: np.ndarray) -> DataFrame:
    """C1 scores of a language model, and ``ok``: label and probability follow from these coefficients."""
    out = SC.classify(texts, tm).select("item_id", "predictedLabel", F.array_max(vector_to_array("probability")).alias("_p"))
    again = class_by_join(texts, "item_id", tm.labels, coefficients, intercepts, tm.num_features)
    same = (F.col("predictedLabel") == F.col("label")) & (F.abs(F.col("_p") - F.col("p")) < 1e-9)
    return out.join(again, "item_id", "left").select("item_id", F.lit(tm.classifier).alias("classifier"),
                                                     F.coalesce(same, F.lit(False)).alias("ok"))


@job("q_classify", "SELECT item_id, 'langDomain' AS classifier, true AS ok FROM benchmark")
def q_classify(spark, sf):
    """Benchmark texts scored by the domain model; ok: label and probability follow from its coefficients."""
    tm = domain_model(spark, sf)
    return classify_checked(benchmark_texts(spark, sf), tm, *SC.linear_form(_lr(tm)))


def classify_all_checked(texts: DataFrame, models: LN.LinearSet, proof: LN.LinearSet) -> DataFrame:
    """C2 scores of a set, and ``ok``: score and label follow from the coefficients of ``proof``."""
    out = same_scores(SC.classify_all(texts, models, "item_id", TEXT_FOR), scores_by_join(texts, proof, "item_id", TEXT_FOR),
                      ["item_id", "domain", "classifier"])
    label = F.when(F.col("score") > 0.5, F.col("classifier")).otherwise(F.lit(LB.OTHER))
    return out.select("item_id", "domain", "classifier", (F.col("ok") & (F.col("predictedLabel") == label)).alias("ok"))


@job("q_classify_all", f"SELECT item_id, domain, classifier, true AS ok FROM benchmark, ({_INTENT_KEYS})")
def q_classify_all(spark, sf):
    """Every intent model of both domains on the benchmark texts; ok: the score by joining its coefficients."""
    models = intent_models(spark, sf)
    return classify_all_checked(slot_text(spark, benchmark_texts(spark, sf)), models, models)


def batch_predict_checked(texts: DataFrame, tm: TR.TextModel, coefficients: np.ndarray, intercepts: np.ndarray) -> DataFrame:
    """C5 predictions, and ``known``: the class whose binary model has the greatest margin, by these coefficients."""
    out = PipelineModel(stages=SC._classifier_stages(tm.model)).transform(texts).select("item_id", "predictedLabel")
    again = class_by_join(texts, "item_id", tm.labels, coefficients, intercepts, tm.num_features)
    return out.join(again, "item_id", "left").select(
        "item_id", F.coalesce(F.col("predictedLabel") == F.col("label"), F.lit(False)).alias("known"), F.lit(1.0).alias("score"))


@job("q_batch_predict", """
SELECT item_id, true AS known, CAST(1.0 AS DOUBLE) AS score FROM benchmark""")
def q_batch_predict(spark, sf):
    """OneVsRest(LR) predictions, score 1.0; known: the class of the greatest margin."""
    tm = trained(spark, sf, "domain-ovr", train_domain("ovr_lr"))[0]
    return batch_predict_checked(benchmark_texts(spark, sf), tm, *SC.linear_form(_lr(tm)))


_LANG_KEYS = "SELECT DISTINCT lang AS classifier FROM documents"


def multi_classify(spark, sf) -> DataFrame:
    """P(key) of every language-vs-rest model for every benchmark text."""
    return SC.classify_all(benchmark_texts(spark, sf), one_vs_rest_models(spark, sf), "item_id")


def multi_classify_join(spark, sf) -> DataFrame:
    """C6 by joining hashed TF with the coefficient table (one shuffle and one plan for any number of models)."""
    return scores_by_join(benchmark_texts(spark, sf), one_vs_rest_models(spark, sf), "item_id")


@job("q_multi_classify", f"SELECT item_id, 'lang' AS domain, classifier, true AS ok FROM benchmark, ({_LANG_KEYS})")
def q_multi_classify(spark, sf):
    """C6; ok: the score by joining the coefficients."""
    keys = ["item_id", "domain", "classifier"]
    return same_scores(multi_classify(spark, sf), multi_classify_join(spark, sf), keys).select(*keys, "ok")


@job("q_multi_classify_join", f"""
SELECT item_id, 'lang' AS domain, classifier, true AS same_as_transform FROM benchmark, ({_LANG_KEYS})""")
def q_multi_classify_join(spark, sf):
    keys = ["item_id", "domain", "classifier"]
    return same_scores(multi_classify_join(spark, sf), multi_classify(spark, sf), keys, "same_as_transform").select(
        *keys, "same_as_transform")


def task_features(spark, sf, turns: DataFrame, order: list[str]) -> DataFrame:
    """C4 training form: intent scores ‖ running domain prior in ``order``, per turn."""
    pri = CX.domain_prior(turns, order)
    st = SC.stacked_scores(slot_text(spark, pri), intent_models(spark, sf), TEXT_FOR)
    return st.withColumn("classifierFeatures", F.concat("scores", "prior"))


#: The two dialogue models of the reference: turns in file order, and shuffled; the running prior follows the order.
TASK_MODELS = ("longRunning", "multiDomain")


def task_frame(spark, sf, name: str = "longRunning") -> DataFrame:
    """Stacked features of every turn of a dialogue file (prior in file
    order, as the reference computes it), with the conversation-level split."""
    def build():
        turns = SP.hash_split(S.turns(spark, sf), "conv_id")
        if name == "longRunning":
            return task_features(spark, sf, turns, ["conv_id", "turn"])
        place = F.xxhash64("conv_id", "turn", F.lit(SP.SEED))  # the shuffled file's order
        return task_features(spark, sf, turns.withColumn("_place", place), ["_place"]).drop("_place")
    return kept_table(spark, sf, f"task-{name}", build)


def train_task(name: str = "longRunning"):
    """One of the two dialogue models."""
    def train(spark, sf) -> list[TR.TextModel]:
        f = task_frame(spark, sf, name)
        m = TR.train_task_model(f.filter("is_train"), f)
        return [TR.TextModel("dialog", name, "task", m, TR.model_labels(m), 0)]
    return train


def task_text_model(spark, sf, name: str = "longRunning") -> TR.TextModel:
    return trained(spark, sf, f"task-{name}", train_task(name))[0]


def task_model(spark, sf) -> PipelineModel:
    return task_text_model(spark, sf).model


def task_vectors(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the assembled ``features`` (and ``label``) that the model's forests read."""
    cut = next(i for i, st in enumerate(model.stages) if hasattr(st, "models"))
    return PipelineModel(stages=model.stages[:cut]).transform(TR.task_input(rows))


def _forests(model: PipelineModel) -> list:
    return next(st for st in model.stages if hasattr(st, "models")).models


def task_deviations(spark, sf, tm: TR.TextModel) -> dict[str, float]:
    """Per label the leaf deviation of its forest on the training turns."""
    rows = task_vectors(tm.model, task_frame(spark, sf, tm.classifier).filter("is_train")).select("features", "label")
    return {label: forest_deviation(spark, rows.select("features", (F.col("label") == i).cast("int").alias("label")), f)
            for i, (label, f) in enumerate(zip(tm.labels, _forests(tm.model), strict=True))}


def evaluate_task(spark, sf, name: str = "longRunning") -> DataFrame:
    tm = train_and_save(spark, sf, f"task-{name}", train_task(name))[0]
    out = tm.model.transform(TR.task_input(task_frame(spark, sf, name).filter(~F.col("is_train"))))
    per = EV.metrics_by_label(out)
    return per.withColumn("value", F.get(F.array(*[F.lit(x) for x in tm.labels]), F.col("label").cast("int")))


_TASK_TEST = f"""
SELECT role AS label, count(*) AS n_label, true AS ok FROM conversations
WHERE {_SPLIT.format(k='conv_id')} >= 80 GROUP BY role"""


def _proved_task(spark, sf, name: str) -> DataFrame:
    per = evaluate_task(spark, sf, name)
    found = task_deviations(spark, sf, task_text_model(spark, sf, name))
    return _domain_result(per, _is_small(found, F.col("value"), LEAF_DEVIATIONS))


@job("q_train_task", _TASK_TEST)
def q_train_task(spark, sf):
    """Dialogue-task model, evaluated per label on held-out conversations; ok: its leaves hold its training rows."""
    return _proved_task(spark, sf, "longRunning")


@job("q_train_task_shuffled", _TASK_TEST)
def q_train_task_shuffled(spark, sf):
    """The second dialogue model, on the shuffled turns."""
    return _proved_task(spark, sf, "multiDomain")


def task_requests(spark, sf) -> DataFrame:
    """Requests {conv_id, turn, text, prevTask, domainBias} from conversations."""
    from parlance.plans.context_jobs import _BIAS
    conv = TB.read_table(spark, sf, "conversations")
    p = CX.previous_task(conv, ["conv_id"], ["turn"], "role", out_col="prev")
    return p.select("conv_id", "turn", "text", F.concat(F.lit("dialog."), F.col("prev")).alias("prevTask"),
                    F.expr(_BIAS.replace("VARCHAR", "STRING")).alias("domainBias"))


def classify_task(spark, sf, requests: DataFrame) -> DataFrame:
    """Next task from (text, previous task, domain bias)."""
    from parlance.streaming.requests import task_requests_scored
    return task_requests_scored(requests, intent_models(spark, sf), task_model(spark, sf),
                                lambda d: slot_text(spark, d), TEXT_FOR, ["conv_id", "turn"])


def task_by_nodes(spark, sf, requests: DataFrame, tm: TR.TextModel, forests: list[FO.Trees], ids: list[str]) -> DataFrame:
    """{ids..., label}: C3 with the forests evaluated from their nodes."""
    from parlance.streaming.requests import task_request_features
    feats = task_request_features(requests, intent_models(spark, sf), lambda d: slot_text(spark, d), TEXT_FOR)
    rows = task_vectors(tm.model, feats).select(*ids, "features")
    names = F.array(*[F.lit(x) for x in tm.labels])
    return FO.one_vs_rest_classes(rows, forests).select(*ids, F.get(names, F.col("_class")).alias("label"))


_ROLES = "SELECT DISTINCT role FROM conversations"


@job("q_classify_task", "SELECT conv_id, turn, true AS ok FROM conversations")
def q_classify_task(spark, sf):
    """C3/K4; ok: the response is the task that the forests' nodes vote for."""
    tm = task_text_model(spark, sf)
    requests, ids = task_requests(spark, sf), ["conv_id", "turn"]
    again = task_by_nodes(spark, sf, requests, tm, [FO.read_trees(spark, f) for f in _forests(tm.model)], ids)
    out = classify_task(spark, sf, requests).join(again, ids, "left")
    body = F.from_json("response", "label string, score double")
    return out.select(*ids, F.coalesce((body["score"] == 1.0) & (body["label"] == F.col("predictedLabel"))
                                       & (F.col("label") == F.col("predictedLabel")), F.lit(False)).alias("ok"))


# ---------------------------------------------------------------- the whole training run
def domain_rows_of(spark, sf, domain: str) -> DataFrame:
    """{line_id, is_train, features, strLabel}: every document, labelled ``<domain>Domain`` or ``Other``."""
    docs = S.documents(spark, sf, ("doc_id", "lang")).select(
        F.col("doc_id").alias("line_id"), S.domain_of_lang(F.col("lang")).alias("_domain"))
    label = F.when(F.col("_domain") == domain, F.lit(f"{domain}Domain")).otherwise(F.lit(LB.OTHER))
    frame = domain_frame(spark, sf).drop("strLabel")
    return frame.join(docs.select("line_id", label.alias("strLabel")), "line_id")


def train_own_domains(spark, sf) -> list[TR.TextModel]:
    """M1 per domain: is a text of this domain?"""
    out = []
    for domain in CX.DOMAINS:
        f = domain_rows_of(spark, sf, domain)
        m = TR.train_on_features(f.filter("is_train"), f, num_features=DOMAIN_FEATURES)
        out.append(TR.TextModel(domain, f"{domain}Domain", "domain", m, TR.model_labels(m), DOMAIN_FEATURES))
    return out


def train_main(spark, sf) -> list:
    """All models of the reference's main, each after those it needs: the intents and the domain model of both domains,
    then the two dialogue models on the intents' scores."""
    intents = train_and_save(spark, sf, "intents", train_intents)  # the dialogue models' features come from these
    own = train_own_domains(spark, sf)
    return [*intents, *own, *[m for name in TASK_MODELS for m in train_task(name)(spark, sf)]]


# Fixed values of the reference: the texts its main checks the models with, and their previous tasks.
CHECK_TEXTS = [
    (-1, "compare Kobe and Curry", "na"),
    (-2, "weather in sfo", "na"),
    (-3, "compare Kobe and Curry", "na"),
    (-4, "How is weather in sfo", "na"),
    (-5, "curry", "comparePlayers"),
    (-6, "curry", "na"),
]
CHECK_BIAS = "nba:0.5,weather:0.5"


def check_texts(spark, sf) -> DataFrame:
    """{item_id, utterance, prevTask, domainBias}: the benchmark texts and the six fixed ones."""
    fixed = spark.createDataFrame(CHECK_TEXTS, "item_id long, utterance string, prevTask string")
    texts = benchmark_texts(spark, sf).select(F.col("item_id").cast("long").alias("item_id"), "utterance",
                                              F.lit("na").alias("prevTask"))
    return texts.unionByName(fixed).withColumn("domainBias", F.lit(CHECK_BIAS))


def score_main(spark, sf, root: str) -> DataFrame:
    """{item_id, domain, classifier, predictedLabel, score} of every check text by every model of one saved version."""
    from parlance.streaming.requests import task_requests_scored
    version = ST.current(spark, root)
    intents = ST.load_linear(spark, root, version=version)
    texts = check_texts(spark, sf)
    slots = slot_text(spark, texts)
    out = SC.classify_all(slots, intents, "item_id", TEXT_FOR).unionByName(
        SC.classify_all(slots, ST.load_models(spark, root, kind="domain", version=version), "item_id", TEXT_FOR))
    requests = texts.withColumnRenamed("utterance", "text")
    for tm in ST.load_models(spark, root, kind="task", version=version):
        tasks = task_requests_scored(requests, intents, tm.model, lambda d: slot_text(spark, d), TEXT_FOR, ["item_id"])
        out = out.unionByName(tasks.select("item_id", F.lit(tm.domain).alias("domain"), F.lit(tm.classifier).alias("classifier"),
                                           "predictedLabel", F.lit(1.0).alias("score")))
    return out


def train_and_check(spark, sf) -> DataFrame:
    """C7 flagship: trains all models of the reference's main, records them in one version of the store, and scores the
    benchmark texts and the six fixed ones by all of them; one row per (text, model)."""
    train_and_save(spark, sf, "main", train_main)
    return score_main(spark, sf, model_root(spark, sf, "main"))


_CHECKED = f"""
SELECT CAST(item_id AS BIGINT) AS item_id FROM benchmark UNION ALL SELECT -i AS item_id FROM range(1, 7) t(i)"""
_MAIN_MODELS = f"""{_INTENT_KEYS} UNION ALL SELECT 'nba', 'nbaDomain' UNION ALL SELECT 'weather', 'weatherDomain'
UNION ALL SELECT 'dialog', 'longRunning' UNION ALL SELECT 'dialog', 'multiDomain'"""


def main_by_coefficients(spark, sf, root: str) -> DataFrame:
    """{item_id, domain, classifier, label, again}: ``score_main`` computed anew from coefficients and nodes."""
    texts = check_texts(spark, sf)
    slots = slot_text(spark, texts)
    intents = ST.load_linear(spark, root)
    label = F.when(F.col("score") > 0.5, F.col("classifier")).otherwise(F.lit(LB.OTHER))
    out = scores_by_join(slots, intents, "item_id", TEXT_FOR).select(
        "item_id", "domain", "classifier", label.alias("label"), F.col("score").alias("again"))
    for tm in ST.load_models(spark, root, kind="domain"):
        own = class_by_join(slots, "item_id", tm.labels, *SC.linear_form(_lr(tm)), tm.num_features, TEXT_FOR[tm.domain])
        p = F.when(F.col("label") == tm.classifier, F.col("p")).otherwise(1 - F.col("p"))
        out = out.unionByName(own.select("item_id", F.lit(tm.domain).alias("domain"), F.lit(tm.classifier).alias("classifier"),
                                         "label", p.alias("again")))
    requests = texts.withColumnRenamed("utterance", "text")
    for tm in ST.load_models(spark, root, kind="task"):
        forests = [FO.read_trees(spark, f) for f in _forests(tm.model)]
        own = task_by_nodes(spark, sf, requests, tm, forests, ["item_id"])
        out = out.unionByName(own.select("item_id", F.lit(tm.domain).alias("domain"), F.lit(tm.classifier).alias("classifier"),
                                         "label", F.lit(1.0).alias("again")))
    return out


@job("q_train_and_check", f"SELECT item_id, domain, classifier, true AS ok FROM ({_CHECKED}), ({_MAIN_MODELS})")
def q_train_and_check(spark, sf):
    """C7; ok: label and score follow from the models' coefficients and nodes."""
    keys = ["item_id", "domain", "classifier"]
    scored = train_and_check(spark, sf)
    both = scored.join(main_by_coefficients(spark, sf, model_root(spark, sf, "main")), keys, "left")
    same = (F.col("predictedLabel") == F.col("label")) & (F.abs(F.col("score") - F.col("again")) < 1e-9)
    return both.select(*keys, F.coalesce(same, F.lit(False)).alias("ok"))


# ---------------------------------------------------------------- streaming
def stream_table(spark, path: str, max_files: int | None = None) -> DataFrame:
    """A table (a file or a folder of part files) as a stream; ``max_files`` per micro-batch, all by default."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # as a pattern for exactly this path: a stream takes no single file otherwise
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def stream_folder(spark, sf: str, name: str) -> str:
    """Sink and checkpoint of a stream over one state of the tables: the same over restarts."""
    return scratch_path(spark, "streams", table_state(spark, sf), name, unique=False)


def classify_log(docs: DataFrame) -> DataFrame:
    """/classify requests from documents: json or text, one domain or both."""
    return docs.select(F.col("doc_id").alias("request_id"), "text",
                       F.when(F.col("doc_id") % 2 == 0, F.lit("json")).otherwise(F.lit("text")).alias("type"),
                       F.when(F.col("doc_id") % 3 == 0, F.lit("nba"))
                       .when(F.col("doc_id") % 3 == 1, F.lit("weather")).alias("domain"))


def stream_classify(spark, sf, folder: str) -> DataFrame:
    """The answers to /classify requests from a stream (documents as the request log)."""
    from parlance.streaming.requests import classify_requests, run_to_parquet
    scored = classify_requests(classify_log(stream_table(spark, f"{sf}/documents.parquet")), intent_models(spark, sf),
                               lambda d: slot_text(spark, d), TEXT_FOR, ["request_id"])
    return spark.read.parquet(run_to_parquet(scored, folder))


@job("q_stream_classify", "SELECT doc_id AS request_id, true AS same_as_batch FROM documents")
def q_stream_classify(spark, sf):
    """R1; every streamed answer is compared with the batch answer."""
    from parlance.streaming.requests import classify_requests
    streamed = stream_classify(spark, sf, stream_folder(spark, sf, "classify"))
    batch = classify_requests(classify_log(TB.read_table(spark, sf, "documents")), intent_models(spark, sf),
                              lambda d: slot_text(spark, d), TEXT_FOR, ["request_id"])
    both = streamed.join(batch.withColumnRenamed("response", "batch"), "request_id", "left")
    return both.select("request_id", F.col("response").eqNullSafe(F.col("batch")).alias("same_as_batch"))


def stream_task(spark, sf, folder: str) -> DataFrame:
    """R2: the answers to /taskScore requests from a stream.

    The request log is a table: each turn's text with the task of the turn
    before it, as a client would send it.
    """
    from parlance.streaming.requests import run_batches_to_parquet
    requests = stream_table(spark, kept_folder(spark, sf, "task-requests", lambda: task_requests(spark, sf)))
    return spark.read.parquet(run_batches_to_parquet(requests, lambda b: classify_task(spark, sf, b), folder))


@job("q_stream_task", "SELECT conv_id, turn, true AS same_as_batch FROM conversations")
def q_stream_task(spark, sf):
    """R2; every streamed answer is compared with the batch answer."""
    streamed = stream_task(spark, sf, stream_folder(spark, sf, "task")).select("conv_id", "turn", "response")
    batch = classify_task(spark, sf, task_requests(spark, sf)).select(
        "conv_id", "turn", F.col("response").alias("batch"))
    both = streamed.join(batch, ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", F.col("response").eqNullSafe(F.col("batch")).alias("same_as_batch"))


def stream_context(spark, sf, folder: str, path: str | None = None, max_files: int | None = None) -> DataFrame:
    """W1/W2 over a stream of turns: {conv_id, turn, task, domain, previousTask, prior}."""
    from parlance.streaming import context as SX
    turns = stream_table(spark, path or f"{sf}/conversations.parquet", max_files).select(
        "conv_id", "turn", F.col("role").alias("task"), TB.turn_domain(F.col("conv_id") + F.col("turn")).alias("domain"))
    return SX.context(spark, SX.run_context(turns, folder))


_STREAM_DOMAIN = "CASE (conv_id + turn) % 3 WHEN 0 THEN 'nba' WHEN 1 THEN 'weather' END"
_STREAM_PRIOR = """CASE WHEN domain IS NULL THEN 0.5 ELSE
  sum(CASE WHEN domain = '{d}' THEN 1 ELSE 0 END) OVER w / count(domain) OVER w END AS prior_{d}"""


@job("q_stream_context", f"""
SELECT conv_id, turn, role, coalesce(lag(role) OVER w, 'na') AS previousTask,
  {_STREAM_PRIOR.format(d='nba')}, {_STREAM_PRIOR.format(d='weather')}
FROM (SELECT DISTINCT conv_id, turn, role, {_STREAM_DOMAIN} AS domain FROM conversations)
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def q_stream_context(spark, sf):
    """W1/W2 with keyed state: the turns as a stream, equal to the windows over the whole table."""
    out = stream_context(spark, sf, stream_folder(spark, sf, "context"))
    return out.select("conv_id", "turn", F.col("task").alias("role"), "previousTask", F.col("prior")[0].alias("prior_nba"),
                      F.col("prior")[1].alias("prior_weather"))


# ---------------------------------------------------------------- files of the reference's formats
def written(spark, sf, name: str, write) -> str:
    """Folder of files in one of the reference's formats, derived from the tables and kept per state of them."""
    root = scratch_path(spark, "files", table_state(spark, sf), name, unique=False)
    return ST.current(spark, root) or ST.publish(spark, root, write)


@job("q_turn_file", f"SELECT utterance, previousTask, strLabel, domain, true AS numbered FROM ({_TURNS})")
def q_turn_file(spark, sf):
    """The dialogue file as text lines, scanned and parsed; numbered: line numbers are 0, 1, ... without gaps."""
    lines = TB.turn_lines(TB.read_table(spark, sf, "conversations")).select("value")
    rows = FL.read_turns(spark, written(spark, sf, "turns", lambda folder: lines.write.text(folder)), min_fields=3)
    seen = rows.agg((F.min("line_id") == 0) & (F.max("line_id") == F.count("*") - 1)
                    & (F.sum("line_id") == F.count("*") * (F.count("*") - 1) / 2)).scalar()
    return rows.select("utterance", "previousTask", "strLabel", "domain", seen.alias("numbered"))


@job("q_numeric_csv", """
SELECT CAST(label AS DOUBLE) AS label, len(embedding) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
  round(CAST(embedding[-1] AS DOUBLE), 6) AS last_value FROM embeddings""")
def q_numeric_csv(spark, sf):
    """The embeddings as a comma file of numbers, the label last, read as vectors."""
    rows = TB.read_table(spark, sf, "embeddings")
    width = rows.select(F.size("embedding")).first()
    columns = (width[0] if width else 0) + 1
    line = F.concat_ws(",", F.transform("embedding", lambda x: x.cast("double").cast("string")), F.col("label").cast("string"))
    folder = written(spark, sf, "embeddings", lambda f: rows.select(line.alias("value")).write.text(f))
    x = vector_to_array("features")
    return FL.read_labelled_csv(spark, folder, columns, columns - 1).select(
        "label", F.size(x).cast("long").alias("width"), F.round(x[0], 6).alias("first_value"),
        F.round(F.element_at(x, -1), 6).alias("last_value"))
