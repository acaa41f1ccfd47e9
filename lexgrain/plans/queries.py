"""Registered queries: name -> function of (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrain.functions import scores
from lexgrain.functions import text as tx
from lexgrain.operators import (
    compare,
    ensemble,
    features,
    fold_models,
    metrics,
    models,
    profile,
    quantiles,
    reconcile,
    sketches,
    splits,
    subwords,
)
from lexgrain.operators.layout import with_positions
from lexgrain.operators.tfidf import TfidfModel, ngram_frequencies, ngram_rows, vocabulary
from lexgrain.plans import relations as rel
from lexgrain.plans import workflows
from lexgrain.session import kept_table, new_scratch_path
from lexgrain.sources import readers, sinks
from lexgrain.streaming.files import process_new_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for comparison with another engine's summation order."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# Sources and sinks


@query
def pair_explode(spark, folder):
    records = rel.pairs(spark, folder)
    exploded = readers.explode_pairs(records, keep=("conv_id", "pair_no"))
    return exploded.withColumn("pos", F.col("pos").cast("bigint"))


@query
def positional_ids(spark, folder):
    exploded = readers.explode_pairs(rel.pairs(spark, folder), keep=("conv_id", "pair_no"))
    return with_positions(exploded, ["conv_id", "pair_no", "pos"]).select("id", "sentence", "label")


@query
def flat_labelled_scan(spark, folder):
    """Up to four records in one array; every third id goes without idx and takes its position."""
    record = F.struct(
        "id",
        "sentence",
        F.col("label").cast("string").alias("label"),
        F.when(F.col("id") % 3 != 0, F.col("id")).alias("idx"),
    )
    arrays = (
        rel.sent(spark, folder)
        .groupBy(F.expr("id div 4").alias("doc"))
        .agg(F.to_json(F.sort_array(F.collect_list(record))).alias("value"))
    )
    return readers.parse_flat(arrays, keep=("doc",))


@query
def json_array_scan(spark, folder):
    """Records in array files, each cut among tasks; every third id goes without idx and takes its place."""
    path = new_scratch_path(spark, "arrays")
    record = F.struct(
        "sentence",
        F.col("label").cast("string").alias("label"),
        F.when(F.col("id") % 3 != 0, F.col("id")).alias("idx"),
    )
    place = Window.partitionBy("file").orderBy("id")
    back = Window.partitionBy("file").orderBy(F.desc("id"))
    rows = rel.sent(spark, folder).withColumn("file", F.expr("id div 2000"))
    rows = rows.select("file", "id", "sentence", "label", F.row_number().over(place).alias("n"), F.row_number().over(back).alias("m"))
    value = F.concat(
        F.when(F.col("n") == 1, "[").otherwise(""), F.to_json(record), F.when(F.col("m") == 1, "]").otherwise("")
    )
    # Stretches between commas: the text sink puts one behind every record.
    written = rows.select("file", "id", value.alias("value")).repartition("file").sortWithinPartitions("file", "id")
    written.drop("id").write.partitionBy("file").option("lineSep", ",").text(path)
    name = F.regexp_extract("file", r"/file=(\d+)/", 1).cast("bigint")
    return readers.read_flat(spark, path, keep=("file",)).withColumn("file", name)


def _json_lines(spark, rows, name):
    """Write rows as JSON Lines and return the path."""
    path = new_scratch_path(spark, name)
    rows.write.json(path)
    return path


@query
def pair_file_scan(spark, folder):
    """Pair records written as JSON Lines and read back."""
    records = rel.pairs(spark, folder).select("sentence_pair", "label_pair")
    read = readers.read_pairs(spark, _json_lines(spark, records, "pairs"), lines=True)
    exploded = readers.explode_pairs(read, keep=("file", "record"))
    return exploded.select(F.col("pos").cast("bigint").alias("pos"), "sentence", "label")


@query
def test_file_scan(spark, folder):
    """Test records with a mandatory idx, written as JSON Lines and read back."""
    records = rel.unlabelled(spark, folder).select(F.col("id").alias("idx"), "sentence")
    return readers.read_test(spark, _json_lines(spark, records, "test"), lines=True)


@query
def oof_csv_roundtrip(spark, folder):
    path = new_scratch_path(spark, "oof")
    sinks.write_oof(rel.oof(spark, folder, 0), path)
    return rounded(readers.read_oof(spark, path))


@query
def polymorphic_json(spark, folder):
    with_idx = F.struct(F.col("text").alias("sentence"), F.col("turn").alias("idx"))
    without_idx = F.struct(F.col("role").alias("sentence"), F.lit(None).cast("bigint").alias("idx"))
    shape = F.col("turn") % 3
    value = (
        F.when(shape == 0, F.to_json(F.struct(F.array("text", "role").alias("sentences"))))
        .when(shape == 1, F.to_json(F.array(with_idx, without_idx)))
        .otherwise(F.to_json(F.array("text", "role")))
    )
    documents = rel.table(spark, folder, "conversations").select(
        "conv_id", "turn", value.alias("value")
    )
    return readers.parse_documents(documents, keep=("conv_id", "turn"))


@query
def csv_roundtrip(spark, folder):
    path = new_scratch_path(spark, "csv")
    predictions = rel.preds(spark, folder)
    packed = predictions.select(
        (F.col("id") * 3 + F.col("model_ord")).alias("id"), "target"
    )
    sinks.write_predictions(packed, path)
    return readers.read_predictions(spark, path)


@query
def union_existing_sources(spark, folder):
    path = new_scratch_path(spark, "models")
    predictions = rel.preds(spark, folder)
    predictions.select("id", "target", "model").write.partitionBy("model").parquet(path)
    paths = {name: f"{path}/model={name}" for name in ("m0", "m1", "absent", "m2")}
    union, _ = readers.read_existing(spark, paths, lambda s, p: s.read.parquet(p))
    return union


# Projections and filters


@query
def project_rename(spark, folder):
    return rel.sent(spark, folder).drop("sentence", "absent").withColumnRenamed("label", "labels")


@query
def filter_by_label(spark, folder):
    return rel.sent(spark, folder).where(F.col("label") == 1)


@query
def fold_select(spark, folder):
    folded = splits.stratified_kfold(rel.labelled_ids(spark, folder).select("id", "label"))
    return splits.fold_train(folded, 0)


@query
def preview_head(spark, folder):
    return rel.one_model(rel.preds(spark, folder), "m2").orderBy("id").limit(10)


@query
def run_summary(spark, folder):
    return rounded(compare.run_summary(rel.runs(spark, folder).drop("basis_points")))


# Joins


@query
def prediction_join(spark, folder):
    predictions = rel.preds(spark, folder)
    return compare.prediction_join(
        rel.one_model(predictions, "m0"), rel.one_model(predictions, "m1")
    )


@query
def pairwise_agreement(spark, folder):
    return rounded(compare.pairwise_agreement(rel.preds(spark, folder)))


def _aligned_sets(spark, folder):
    """Two aligned sets, two of different ids, and two with repeated ids and other labels."""
    a, b = rel.oof(spark, folder, 0), rel.oof(spark, folder, 1)
    other = rel.labelled_ids(spark, folder).select("id", "label")
    third, fifth = a.where("id % 3 = 0"), a.where("id % 5 = 0")
    flipped = third.withColumn("label", 1 - F.col("label"))
    repeated, changed = ensemble.union_all([a, third]), ensemble.union_all([a, flipped, fifth])
    return {"a_b": (a, b), "a_sent": (a, other), "repeated": (repeated, changed)}


def _reports(sets, report):
    return ensemble.union_all(
        [report(x, y, name).withColumn("sets", F.lit(name)) for name, (x, y) in sets.items()]
    )


@query
def oof_alignment_check(spark, folder):
    return _reports(_aligned_sets(spark, folder), lambda x, y, _: ensemble.alignment_report(x, y))


@query
def oof_reconciliation(spark, folder):
    """The same sets by fingerprints of id ranges; rows are compared only where these differ."""
    return _reports(
        _aligned_sets(spark, folder),
        lambda x, y, name: reconcile.reconciliation_report(x, y, unique_ids=name != "repeated"),
    )


@query
def stack_features(spark, folder):
    stacked = ensemble.stack_probabilities(rel.oof(spark, folder, 0), rel.oof(spark, folder, 1))
    return rounded(stacked)


@query
def oof_assemble(spark, folder):
    samples = rel.labelled_ids(spark, folder).select("id", "label")
    held_out = rel.fold_predictions(spark, folder, splits.stratified_kfold(samples))
    return rounded(ensemble.assemble_oof(samples, held_out)).orderBy("id")


# Aggregations


@query
def label_distribution(spark, folder):
    labels = rel.labelled_ids(spark, folder)
    return rounded(profile.label_distribution(labels, classes=(0, 1, 2)))


@query
def prediction_distribution(spark, folder):
    return rounded(compare.prediction_distribution(rel.preds(spark, folder)))


@query
def length_profile(spark, folder):
    return rounded(profile.length_profile(rel.sent(spark, folder)))


@query
def test_length_profile(spark, folder):
    return rounded(profile.length_profile(rel.unlabelled(spark, folder), metrics=("words",)))


@query
def stats_by_label(spark, folder):
    return rounded(profile.stats_by_label(rel.sent(spark, folder)))


@query
def vocab_totals(spark, folder):
    return rounded(profile.vocab_totals(rel.sent(spark, folder)))


@query
def vocab_by_label(spark, folder):
    return profile.vocab_by_label(rel.sent(spark, folder))


@query
def feature_means_long(spark, folder):
    return rounded(profile.feature_means_long(rel.sent(spark, folder)))


@query
def word_histogram(spark, folder):
    return rounded(profile.word_histogram(rel.sent(spark, folder)))


@query
def box_stats(spark, folder):
    return rounded(profile.box_stats(rel.sent(spark, folder)))


@query
def box_outliers(spark, folder):
    return profile.box_outliers(rel.sent(spark, folder))


@query
def feature_quartiles(spark, folder):
    """Quartiles of the ratios, which have about as many values as rows."""
    shaped = features.with_text_features(rel.sent(spark, folder))
    ratios = ["avg_word_len", "punctuation_ratio", "upper_ratio", "space_ratio"]
    return rounded(quantiles.exact_quantiles(shaped, ratios, by=("label",)))


@query
def accuracy_f1(spark, folder):
    return rounded(metrics.accuracy_f1(rel.preds(spark, folder), "y", "target", ("model",)))


@query
def classification_report(spark, folder):
    report = metrics.classification_report(rel.preds(spark, folder), "y", "target", ("model",))
    return rounded(report)


@query
def cv_mean_f1(spark, folder):
    """Folds over all rows that have logits, so every one of them is scored."""
    labelled = rel.logits(spark, folder).where("fold = 0").select("id", "label")
    folded = splits.stratified_kfold(labelled)
    return rounded(metrics.mean_fold_f1(rel.fold_predictions(spark, folder, folded)))


@query
def fold_prob_mean(spark, folder):
    """Logits are stored as model and fold folders and read back before averaging."""
    path = new_scratch_path(spark, "folds")
    scored = rel.logits(spark, folder).select("id", F.lit("a").alias("model"), "fold", "l0", "l1")
    sinks.write_fold_logits(scored, path)
    return rounded(
        ensemble.mean_probability(readers.read_fold_logits(spark, path), ("model", "id"))
    )


@query
def fold_logit_mean(spark, folder):
    return rounded(ensemble.mean_logit(rel.logits(spark, folder)))


@query
def ngram_df(spark, folder):
    return ngram_frequencies(rel.sent(spark, folder))


@query
def standardize_stats(spark, folder):
    rows = features.with_text_features(rel.sent(spark, folder).select("sentence"))
    return rounded(features.scaler_statistics(rows))


@query
def smoothed_cross_entropy(spark, folder):
    rows = rel.logits(spark, folder).withColumn("logits", F.array("l0", "l1"))
    return rounded(metrics.smoothed_cross_entropy(rows, by=("fold",)))


# Windows and splits


@query
def stratified_kfold(spark, folder):
    return splits.stratified_kfold(rel.labelled_ids(spark, folder).select("id", "label"))


@query
def stratified_holdout(spark, folder):
    return splits.stratified_holdout(rel.labelled_ids(spark, folder).select("id", "label"))


@query
def vocab_index(spark, folder):
    return rounded(vocabulary(rel.sent(spark, folder)))


@query
def rank_runs(spark, folder):
    ranked = compare.rank_runs(rel.runs(spark, folder))
    return rounded(ranked.select("experiment", "name", "accuracy", "time", "output_file", "rank"))


@query
def top_words(spark, folder):
    return rounded(profile.top_words(rel.sent(spark, folder)))


@query
def natural_sort(spark, folder):
    return compare.natural_order(rel.fold_names(spark, folder))


# Set operations


@query
def vocab_overlap(spark, folder):
    return profile.vocab_overlap(rel.sent(spark, folder))


def _stored_sketches(spark, folder):
    """Sketches by part and label, written to a folder and merged from there."""
    path = new_scratch_path(spark, "sketches")
    parts = rel.sent(spark, folder).withColumn("part", F.col("id") % 8)
    sketches.store_sketches(sketches.vocabulary_sketches(parts, ("part", "label")), path)
    return sketches.merged_sketches(spark.read.parquet(path))


@query
def sketched_vocab_by_label(spark, folder):
    return sketches.sketched_sizes(_stored_sketches(spark, folder))


@query
def sketched_vocab_overlap(spark, folder):
    return sketches.sketched_overlap(_stored_sketches(spark, folder))


@query
def vocab_except(spark, folder):
    return profile.vocab_except(rel.sent(spark, folder))


@query
def vocab_intersect(spark, folder):
    return profile.vocab_intersect(rel.sent(spark, folder))


@query
def union_predictions(spark, folder):
    predictions = rel.preds(spark, folder)
    return ensemble.union_all([rel.one_model(predictions, m) for m in ("m0", "m1", "m2")])


# Row functions


@query
def clean_text(spark, folder):
    return features.with_cleaned(rel.dirty(spark, folder))


@query
def text_features(spark, folder):
    return rounded(features.with_text_features(rel.dirty(spark, folder)).drop("sentence"))


@query
def streamed_features(spark, folder):
    """Cleaning and features of the labelled documents, which arrive as a stream of files."""
    labels = rel.table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))

    def featured(documents):
        cleaned = features.with_cleaned(documents.join(labels, "doc_id"), "text")
        return features.with_text_features(cleaned.withColumnRenamed("doc_id", "id"), "text").drop("text")

    rows = process_new_files(
        spark,
        f"{folder}/documents.parquet*",
        rel.table(spark, folder, "documents").select("doc_id", "text").schema,
        featured,
        new_scratch_path(spark, "streamed"),
        new_scratch_path(spark, "stream-progress"),
    )
    return rounded(rows)


@query
def tokens_ws(spark, folder):
    tokens = F.posexplode(tx.whitespace_tokens(F.col("sentence"))).alias("pos", "token")
    return rel.sent(spark, folder).select("id", tokens)


@query
def tokens_word(spark, folder):
    tokens = F.posexplode(tx.word_tokens(F.col("sentence"))).alias("pos", "token")
    return rel.sent(spark, folder).select("id", tokens)


@query
def ngrams_1_2(spark, folder):
    return ngram_rows(rel.sent(spark, folder))


@query
def tfidf_weights(spark, folder):
    sent = rel.sent(spark, folder)
    return rounded(TfidfModel.fit(sent).weights(sent))


@query
def tfidf_transform(spark, folder):
    model = TfidfModel.fit(rel.sent(spark, folder))
    return rounded(model.weights(rel.unlabelled(spark, folder)))


@query
def standardize_apply(spark, folder):
    fitted = features.Scaler.fit(
        features.with_text_features(rel.sent(spark, folder).select("sentence"))
    )
    rows = features.with_text_features(rel.unlabelled(spark, folder)).drop("sentence")
    return rounded(fitted.transform(rows))


@query
def softmax_probs(spark, folder):
    probs = scores.softmax(F.array("l0", "l1"))
    rows = rel.logits(spark, folder).select("id", "fold", probs.alias("p"))
    return rounded(
        rows.select("id", "fold", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"))
    )


@query
def argmax_label(spark, folder):
    return rel.logits(spark, folder).select(
        "id", "fold", scores.argmax(F.array("l0", "l1")).alias("target")
    )


@query
def log_metric_extract(spark, folder):
    return compare.log_accuracy(rel.logs(spark, folder))


@query
def subword_inputs(spark, folder):
    """Model inputs of 128 ids by longest match in a public vocabulary."""
    trie = subwords.PieceTrie.of(subwords.read_pieces(rel.PIECES))
    made = subwords.subword_inputs(rel.sent(spark, folder), trie, 128)
    return made.select(
        "id",
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("mask"),
        "n_pieces",
        "truncated",
    )


@query
def truncate_pad(spark, folder):
    length = 128
    tokens = F.col("tokens")
    return (
        rel.sent(spark, folder)
        .select("id", tx.word_tokens(F.col("sentence")).alias("tokens"))
        .select(
            "id",
            F.array_join(tx.pad_tokens(tokens, length, "<pad>"), " ").alias("padded"),
            F.array_join(tx.padding_mask(tokens, length).cast("array<string>"), "").alias("mask"),
            (F.size(tokens) > length).alias("truncated"),
        )
    )


# Models


@query
def rf_pipeline(spark, folder):
    """The real fit and the report of its hold-out."""
    return models.fit_text_classifier(rel.sent(spark, folder)).report


@query
def rf_predict(spark, folder):
    """The real fit saved, loaded and applied: one target per id."""
    path = new_scratch_path(spark, "classifier")
    models.fit_text_classifier(rel.sent(spark, folder), evaluate=False).save(path)
    return models.TextClassifier.load(spark, path).predict(rel.unlabelled(spark, folder))


@query
def stacker_fit(spark, folder):
    a, b = rel.oof(spark, folder, 0), rel.oof(spark, folder, 1)
    ensemble.require_aligned(a, b)
    stacked = ensemble.stack_probabilities(a, b)
    return rounded(models.Stacker.fit(stacked).summary(stacked), 4)


@query
def stacker_predict(spark, folder):
    a, b = rel.oof(spark, folder, 0), rel.oof(spark, folder, 1)
    fitted = models.Stacker.fit(ensemble.stack_probabilities(a, b))
    scored = rel.logits(spark, folder)
    mean_a = ensemble.mean_probability(scored.where("fold % 2 = 0"))
    mean_b = ensemble.mean_probability(scored.where("fold % 2 = 1"))
    return fitted.predict(ensemble.stack_probabilities(mean_a, mean_b)).select("id", "target")


def _fold_models(spark, folder):
    """Folded rows with their features, written once, and the models of all folds."""
    folds = splits.stratified_kfold(rel.labelled_ids(spark, folder).select("id", "label"))
    shaped = fold_models.with_text_shape(rel.sent(spark, folder))
    folded = kept_table(shaped.join(folds.select("id", "fold"), "id"), "folded")
    return folded, fold_models.FoldModels.fit(folded, SHAPE)


SHAPE = ("log_length", "space_share")


def _word_models(spark, folder):
    """Folded rows with the hashed words of their texts, written once, and the models of all folds."""
    folds = splits.stratified_kfold(rel.labelled_ids(spark, folder).select("id", "label"))
    counted = models.with_hashed_counts(rel.sent(spark, folder))
    folded = kept_table(counted.join(folds.select("id", "fold"), "id"), "folded")
    return folded, fold_models.WordFoldModels.fit(folded)


@query
def oof_generate(spark, folder):
    """Every fold scored by the model that hasn't seen it; all models in one pass a step."""
    folded, fitted = _word_models(spark, folder)
    return rounded(fitted.out_of_fold(folded), 5)


@query
def fold_test_scores(spark, folder):
    """Test rows under every fold's model, their mean logit as probability and label."""
    _, fitted = _word_models(spark, folder)
    logits = fitted.scores(models.with_hashed_counts(rel.unlabelled(spark, folder)))
    folds = logits.groupBy("id").agg(F.count_distinct("fold").alias("n_folds"))
    return rounded(ensemble.mean_logit(logits).join(folds, "id"), 5)


@query
def stored_fold_scores(spark, folder):
    """The fold models saved, loaded by workers and applied in batches: a logit per id and fold."""
    path = new_scratch_path(spark, "fold-models") + "/weights.npy"
    _fold_models(spark, folder)[1].save(path)
    score = models.batch_scorer(fold_models.stored_scorer(path), width=len(SHAPE), batch_size=1024)
    test = fold_models.with_text_shape(rel.unlabelled(spark, folder))
    scored = test.select("id", F.posexplode(score(F.array(*SHAPE))).alias("fold", "l1"))
    return rounded(scored, 5)


@query
def batch_score(spark, folder):
    weights = [[((i * 7 + c * 3) % 11 - 5) / 10.0 for c in (0, 1)] for i in range(64)]
    score = models.batch_scorer(models.linear_scorer(weights), width=64)
    rows = rel.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), score(F.col("embedding")).alias("s")
    )
    return rounded(rows.select("id", F.col("s")[0].alias("l0"), F.col("s")[1].alias("l1")))
