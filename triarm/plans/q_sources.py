"""Scans and sinks: tables are written to the shared folder and read back."""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from triarm.functions.draws import digit
from triarm.operators import regression, scoring, summary
from triarm.plans.catalog import query
from triarm.plans.inputs import (
    ACC, CTES, NUM, accuracies, documents, full_accuracies, predictions, r6, sql, sql_digit, table,
)
from triarm.plans.q_arms import CLASSES, PREDICT, predicted
from triarm.plans.q_reshape import DRAW_CTES, draw_table
from triarm.plans.q_sampling import vectors
from triarm.plans.q_statistics import BOARD, META_CTES, board, meta
from triarm.plans.run import read_table, write_table
from triarm.operators.sampling import replicate_splits
from triarm.sources import results
from triarm.sources.datasets import scan_split
from triarm.sources.scratch import new_path, stored
from triarm.streaming import results as streaming

KEYS = ("num_train", "num_test", "lm_type", "dataset", "subsample_idx")
ARMS = ("base", "extra", "test")
VALUES = (*ARMS, "majority", "majority_all")
G5 = "num_train, num_test, lm_type, dataset, subsample_idx"
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in VALUES)


@query("scan_split_fallback", """
SELECT 'train' AS split, lang, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents WHERE n_chars >= 1000 GROUP BY 2
UNION ALL
SELECT 'test', lang, count(*), CAST(sum(length(text)) AS BIGINT) FROM documents WHERE n_chars < 1000 GROUP BY 2""")
def scan_split_fallback(spark, sf_dir):
    """One table has both splits; of the other, which has no train split, test is read."""
    docs = table(spark, sf_dir, "documents")
    split = F.when(F.col("n_chars") >= 1000, "train").otherwise("test")
    both, test_only = new_path(spark, "both"), new_path(spark, "test_only")
    docs.withColumn("split", split).write.partitionBy("split").parquet(both)
    docs.withColumn("split", split).where("split = 'test'").write.partitionBy("split").parquet(test_only)
    scans = [scan_split(spark, root) for root in (both, test_only)]
    rows = scans[0].unionByName(scans[1])
    return rows.groupBy("split", "lang").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars")
    )


@query("scan_subset", "SELECT doc_id, 'en' AS subset, source FROM documents WHERE lang = 'en'")
def scan_subset(spark, sf_dir):
    root = new_path(spark, "subsets")
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "subset").withColumn("split", F.lit("train"))
    docs.write.partitionBy("subset", "split").parquet(root)
    return scan_split(spark, root, subset="en").select("doc_id", "subset", "source")


def tree(spark, sf_dir):
    path = new_path(spark, "tree")
    results.write_accuracy_tree(full_accuracies(spark, sf_dir), path)
    return path


def _rounded(df):
    return df.select(*KEYS, "num_classes", *[r6(c).alias(c) for c in VALUES])


@query("accuracy_scan", sql(f"""
SELECT {G5}, num_classes, {ROUNDED} FROM accuracies WHERE num_train = 50 AND num_test = 100 AND lm_type = 'lm_a'""", *ACC))
def accuracy_scan(spark, sf_dir):
    """One configuration and LM type; other files are not listed."""
    return _rounded(results.read_accuracy_tree(spark, tree(spark, sf_dir), 50, 100, "lm_a"))


@query("accuracy_scan_all", sql(f"SELECT {G5}, num_classes, {ROUNDED} FROM accuracies WHERE num_test = 50", *ACC))
def accuracy_scan_all(spark, sf_dir):
    """All LM types of one test size."""
    rows = results.read_accuracy_tree(spark, tree(spark, sf_dir), num_test=50)
    return _rounded(rows).orderBy("lm_type", "dataset", "num_train", "subsample_idx")


@query("accuracy_scan_grid", sql(f"SELECT {G5}, num_classes, {ROUNDED} FROM accuracies", *ACC))
def accuracy_scan_grid(spark, sf_dir):
    return _rounded(results.read_accuracy_tree(spark, tree(spark, sf_dir)))


@query("num_correct_scan", sql(f"""
SELECT {G5}, num_classes, base, extra, test, majority, majority_all FROM num_correct WHERE num_test = 50""", *NUM))
def num_correct_scan(spark, sf_dir):
    """Accuracy files of one test size as counts."""
    rows = results.read_accuracy_tree(spark, tree(spark, sf_dir), num_test=50)
    return summary.num_correct(rows, F.col("num_test")).select(*KEYS, "num_classes", *VALUES)


@query("meta_table", sql("""
SELECT num_train, num_test, replicate, n_subsamples, effect, round(log_odds, 6) AS log_odds, round(mean, 6) AS mean FROM meta""",
    *META_CTES))
def meta_table(spark, sf_dir):
    """A small result table, written as CSV and read again."""
    path, table_ = new_path(spark, "meta"), meta(spark, sf_dir)
    write_table(table_, path)
    schema = "num_train int, num_test int, replicate int, n_subsamples long, effect string, log_odds double, mean double"
    rows = read_table(spark, path, schema)
    return rows.withColumns({"log_odds": r6("log_odds"), "mean": r6("mean")})


@query("merge_runs", sql(f"""
SELECT {G5}, CASE WHEN lm_type = 'lm_b' THEN '2024-08-14 10:00:00' ELSE '2024-08-13 19:06:44' END AS run_time,
       round(CASE WHEN lm_type = 'lm_b' THEN 1 - base ELSE base END, 6) AS base FROM accuracies""", *ACC))
def merge_runs(spark, sf_dir):
    """Two runs share the results of one LM type; the later run wins."""
    home, acc = new_path(spark, "runs"), full_accuracies(spark, sf_dir)
    results.write_accuracy_tree(acc, f"{home}/run-2024-08-13_19-06-44-first/accuracies")
    again = acc.where("lm_type = 'lm_b'").withColumn("base", 1 - F.col("base"))
    results.write_accuracy_tree(again, f"{home}/run-2024-08-14_10-00-00/accuracies")
    merged = results.latest_runs(results.read_accuracy_tree(spark, home, runs="run-*/accuracies"))
    when = F.date_format("run_time", "yyyy-MM-dd HH:mm:ss").alias("run_time")
    return merged.select(*KEYS, when, r6("base").alias("base"))


@query("merge_trees", sql(f"""
SELECT {G5}, round(CASE WHEN lm_type = 'lm_b' THEN 1 - base ELSE base END, 6) AS base FROM accuracies""", *ACC))
def merge_trees(spark, sf_dir):
    """A tree outside of any run folder, and a run that replaces some of its groups, as one tree."""
    home, acc = new_path(spark, "trees"), full_accuracies(spark, sf_dir)
    results.write_accuracy_tree(acc, f"{home}/accuracies")
    again = acc.where("lm_type = 'lm_b'").withColumn("base", 1 - F.col("base"))
    results.write_accuracy_tree(again, f"{home}/run-2024-08-14_10-00-00/accuracies")
    plain, dated = (results.read_accuracy_tree(spark, home, runs=r) for r in ("accuracies", "run-*/accuracies"))
    results.write_accuracy_tree(results.latest_runs(plain.unionByName(dated)), f"{home}/merged")
    return results.read_accuracy_tree(spark, f"{home}/merged").select(*KEYS, r6("base").alias("base"))


@query("accuracy_scan_gaps", sql(f"""
SELECT {G5}, num_classes, {ROUNDED} FROM accuracies WHERE (subsample_idx + length(dataset)) % 3 <> 0""", *ACC))
def accuracy_scan_gaps(spark, sf_dir):
    """Groups that lack some subsamples keep the numbers of the others."""
    path, acc = new_path(spark, "gaps"), full_accuracies(spark, sf_dir)
    results.write_accuracy_tree(acc.where((F.col("subsample_idx") + F.length("dataset")) % 3 != 0), path)
    return _rounded(results.read_accuracy_tree(spark, path))


@query("merge_pieces", sql(f"SELECT {G5}, round(test, 6) AS test FROM accuracies", *ACC))
def merge_pieces(spark, sf_dir):
    """A table collected in pieces, read as one."""
    acc, pieces = accuracies(spark, sf_dir), []
    for i, part in enumerate((acc.where("subsample_idx <= 8"), acc.where("subsample_idx > 8"))):
        pieces.append(new_path(spark, f"piece{i}"))
        part.select(*KEYS, "test").write.option("header", True).csv(pieces[-1])
    schema = "num_train int, num_test int, lm_type string, dataset string, subsample_idx int, test double"
    return spark.read.schema(schema).option("header", True).csv(pieces).withColumn("test", r6("test"))


@query("sink_predictions", sql(f"SELECT {G5}, row_id, label, pred_base, pred_extra, pred_test FROM predictions", "predictions"))
def sink_predictions(spark, sf_dir):
    path = new_path(spark, "predictions")
    rows = predictions(spark, sf_dir)
    results.write_predictions(rows, path)
    return spark.read.parquet(path).select(*rows.columns)


@query("sink_accuracies", sql(f"SELECT {G5}, num_classes, {ROUNDED} FROM accuracies", *ACC))
def sink_accuracies(spark, sf_dir):
    path = new_path(spark, "accuracies")
    results.write_accuracies(full_accuracies(spark, sf_dir), path)
    return _rounded(spark.read.parquet(path))


@query("sink_train_metrics", sql("""
SELECT dataset, subsample_idx, 'base' AS split, 'classification' AS train_type, count(*) AS global_step,
       round(avg(CASE WHEN pred_base = label THEN 0e0 ELSE 1e0 END), 6) AS train_loss FROM predictions GROUP BY 1, 2
UNION ALL SELECT DISTINCT dataset, subsample_idx, 'extra', 'pretrain', NULL::BIGINT, NULL::DOUBLE FROM predictions""",
    "predictions"))
def sink_train_metrics(spark, sf_dir):
    """A record of a trained step, and one where nothing was trained."""
    path, rows = new_path(spark, "metrics"), predictions(spark, sf_dir)
    loss = F.avg((F.col("pred_base") != F.col("label")).cast("double"))
    cells = rows.groupBy("dataset", "subsample_idx").agg(F.count(F.lit(1)).alias("steps"), loss.alias("loss"))
    trained = results.train_record(
        F.lit("base"), F.lit("classification"), F.col("steps"), F.create_map(F.lit("train_loss"), F.col("loss"))
    )
    skipped = results.train_record(F.lit("extra"), F.lit("pretrain"))
    results.write_train_metrics(cells.select("dataset", "subsample_idx", F.inline(F.array(trained, skipped))), path)
    return spark.read.parquet(path).select(
        "dataset", "subsample_idx", "split", "train_type", "global_step",
        r6(F.col("metrics")["train_loss"]).alias("train_loss"),
    )


@query("run_manifest", sql("""
SELECT lm_type, num_train, num_test, 16 AS num_subsamples, count(*) AS n_results
FROM accuracies WHERE num_train = 100 AND num_test = 50 GROUP BY 1, 2, 3""", *ACC))
def run_manifest(spark, sf_dir):
    """Manifests of two runs, one of them indented as published ones are, joined to the results they describe."""
    home = new_path(spark, "manifests")
    for lm_type in ("lm_a", "lm_b"):
        experiment = results.Experiment(lm_type, num_subsamples=16, num_train=100, num_test=50)
        results.write_manifest(spark, experiment, f"{home}/{lm_type}")
    indented = F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")
    results.read_manifests(spark, f"{home}/lm_b").select(indented).write.text(f"{home}/indented")
    home = f"{home}/{{lm_a,indented}}"
    runs = results.read_manifests(spark, home)
    keys = ["lm_type", "num_train", "num_test"]
    joined = accuracies(spark, sf_dir).join(runs.select(*keys, "num_subsamples"), keys)
    return joined.groupBy(*keys, "num_subsamples").agg(F.count(F.lit(1)).alias("n_results"))


@query("list_results", sql("SELECT num_train, num_test, lm_type, dataset, count(*) AS n_subsamples FROM accuracies GROUP BY 1, 2, 3, 4", *ACC))
def list_results(spark, sf_dir):
    """Files of a result tree, one per group, and the rows each holds."""
    path = tree(spark, sf_dir)
    files = results.list_files(spark, path).where("length > 0 and path like '%.csv'")
    found = files.select(*results.tree_keys(F.col("path")))
    counts = results.read_accuracy_tree(spark, path).groupBy(*KEYS[:4]).agg(F.count(F.lit(1)).alias("n_subsamples"))
    return found.join(counts, list(KEYS[:4]))


@query("draws_scan", sql("""
SELECT num_train, lm_type, dataset, pair, method, draw, round(pred, 6) AS pred
FROM draws WHERE effect = 'bias' AND num_test = 100""", *DRAW_CTES))
def draws_scan(spark, sf_dir):
    path = new_path(spark, "draws")
    results.write_draws(draw_table(spark, sf_dir), path)
    draws = results.read_draws(spark, path, "bias", 100)
    return draws.select("num_train", "lm_type", "dataset", "pair", "method", "draw", r6("pred").alias("pred"))


@query("leaderboard_scan", sql("""
SELECT CAST(row_number() OVER (ORDER BY user_id) AS INTEGER) AS rank, 'user ' || user_id AS submitter,
       round(score, 6) AS overall FROM board""", *BOARD))
def leaderboard_scan(spark, sf_dir):
    from triarm.operators.prefix import total_before

    path = new_path(spark, "leaderboard")
    numbered = total_before(stored(board(spark, sf_dir), "board"), "n", [], F.col("user_id"), [F.col("user_id")])
    # The published columns; later cells are damaged or missing.
    numbered.select(
        (F.col("n") + 1).alias("Rank"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("Submitter"),
        F.lit("a model").alias("Submission Name"), F.lit("2024-08-13").alias("Submission Date"),
        F.round("score", 6).alias("Overall"), F.when(F.col("user_id") % 2 == 0, "0.7450.944").alias("Task A"),
        F.lit(None).cast("double").alias("Task B"),
    ).write.option("sep", "\t").option("header", True).csv(path)
    return results.read_leaderboard(spark, path)


@query("accuracy_from_preds", sql("""
SELECT dataset, subsample_idx, round(avg((label = pred)::INTEGER) FILTER (WHERE arm = 'base'), 6) AS base,
       round(avg((label = pred)::INTEGER) FILTER (WHERE arm = 'extra'), 6) AS extra,
       round(avg((label = pred)::INTEGER) FILTER (WHERE arm = 'test'), 6) AS test
FROM preds GROUP BY 1, 2""", *PREDICT), also="accuracy_from_preds_all")
def accuracy_from_preds(spark, sf_dir):
    """Accuracies of prediction files with a probability column per class and arm, a tree for each dataset."""
    rows = stored(predicted(spark, sf_dir), "predicted")
    key = ["dataset", "subsample_idx"]
    scored = []
    for dataset, num_classes in CLASSES.items():
        path = new_path(spark, f"preds_{dataset}")
        wide = scoring.probability_columns(rows.where(F.col("dataset") == dataset), [*key, "row_id", "label"], num_classes)
        results.write_predictions_csv(wide, path)
        kinds = ["row_id bigint", "label int", *[f"{c} double" for c in wide.columns if c.startswith("pred_prob")]]
        files = spark.read.schema(", ".join(kinds)).option("header", True).csv(path)
        scored.append(scoring.accuracies(scoring.predictions_from_columns(files), key))
    return reduce(DataFrame.unionByName, scored).select(*key, *[r6(a).alias(a) for a in ARMS])


@query("sink_outcomes", sql(f"""
, arrived AS (
  SELECT 'whole' AS target, num_train, num_test, lm_type, dataset, false AS other FROM accuracies
  UNION ALL SELECT 'faulty', num_train, num_test, lm_type, dataset, false FROM accuracies
            WHERE (lm_type = 'lm_b' OR num_test = 100 OR subsample_idx <= 8) AND (lm_type = 'lm_a' OR num_train = 100)
  UNION ALL SELECT 'faulty', num_train, num_test, lm_type, dataset, false FROM accuracies WHERE lm_type = 'lm_a' AND num_test = 100 AND num_train = 50
  UNION ALL SELECT 'faulty', num_train, num_test, lm_type, 'stray', false FROM accuracies WHERE lm_type = 'lm_b' AND num_train = 100 AND subsample_idx = 1
            AND dataset = (SELECT min(dataset) FROM accuracies)),
  there AS (SELECT target, num_train, num_test, lm_type, dataset, count(*) AS n_found FROM arrived GROUP BY ALL),
  sent AS (SELECT target, num_train, num_test, lm_type, dataset, count(*) AS n_rows
           FROM accuracies CROSS JOIN (VALUES ('whole'), ('faulty')) AS t(target) GROUP BY ALL)
SELECT target, num_train, num_test, lm_type, dataset, n_rows, n_found,
       CASE WHEN n_found IS NULL THEN 'missing' WHEN n_rows IS NULL THEN 'unexpected' WHEN n_found = 2 * n_rows THEN 'doubled'
            WHEN n_found < n_rows THEN 'truncated'
            WHEN target = 'faulty' AND lm_type = 'lm_b' AND num_test = 50 THEN 'changed' ELSE 'complete' END AS outcome
FROM sent FULL JOIN there USING (target, num_train, num_test, lm_type, dataset)""", *ACC))
def sink_outcomes(spark, sf_dir):
    """What became of each group of a result tree in two copies: one whole, one with rows cut off, groups sent twice, left out, changed or not asked for."""
    sent = stored(full_accuracies(spark, sf_dir), "sent")
    a, b = F.col("lm_type") == "lm_a", F.col("lm_type") == "lm_b"
    first = sent.agg(F.min("dataset")).first()[0]
    cut = sent.where((b | (F.col("num_test") == 100) | (F.col("subsample_idx") <= 8)) & (a | (F.col("num_train") == 100)))
    changed = cut.withColumn("base", F.when(b & (F.col("num_test") == 50), F.col("base") / 2 + 0.01).otherwise(F.col("base")))
    twice = sent.where(a & (F.col("num_test") == 100) & (F.col("num_train") == 50))
    stray = sent.where(b & (F.col("num_train") == 100) & (F.col("subsample_idx") == 1) & (F.col("dataset") == F.lit(first)))
    faulty = changed.unionByName(twice).unionByName(stray.withColumn("dataset", F.lit("stray")))

    def held(rows, name):
        path = new_path(spark, name)
        results.write_accuracy_tree(rows, path)
        return results.read_accuracy_tree(spark, path)

    source = held(sent, "source")
    return reduce(DataFrame.unionByName, [
        results.transfer_outcomes(source, held(rows, name)).withColumn("target", F.lit(name))
        for name, rows in (("whole", sent), ("faulty", faulty))])


@query("sink_refusals", sql("""
SELECT sink, true AS refused, count(*) AS n_rows FROM accuracies CROSS JOIN (VALUES ('tree'), ('accuracies')) AS s(sink) GROUP BY sink""", *ACC))
def sink_refusals(spark, sf_dir):
    """A second writer to the same place is refused, and what was there stays."""
    rows = stored(full_accuracies(spark, sf_dir), "accuracies")
    sinks = {"tree": (results.write_accuracy_tree, results.read_accuracy_tree),
             "accuracies": (results.write_accuracies, lambda spark, path: spark.read.parquet(path))}
    found = []
    for name, (write, read) in sinks.items():
        path = new_path(spark, name)
        write(rows, path)
        try:
            write(rows.limit(1), path)
            refused = False
        except AnalysisException as error:
            refused = error.getCondition() == "PATH_ALREADY_EXISTS"
        found.append(read(spark, path).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("sink"), F.lit(refused).alias("refused"), "n_rows"))
    return reduce(DataFrame.unionByName, found)


@query("results_paths", sql("""
SELECT 'run-2024-08-13_19-06-44/accuracies/m' || num_train || '/n' || num_test || '/' || lm_type || '/' || dataset AS path, count(*) AS n_results
FROM accuracies GROUP BY 1""", *ACC))
def results_paths(spark, sf_dir):
    """Where a run puts the results of each group."""
    path = results.results_path(F.lit("run-2024-08-13_19-06-44"))
    return accuracies(spark, sf_dir).groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n_results"))


DELIVERIES = 3
CTES["delivered"] = f"SELECT *, {sql_digit('md5(CAST(row_id AS VARCHAR))', 8)} % {DELIVERIES} AS delivery FROM predictions"


def deliveries(spark, sf_dir):
    """Predictions as they come in: each row in a delivery drawn by its id, half of them in all later ones, too."""
    rows, key = predictions(spark, sf_dir), F.md5(F.col("row_id").cast("string"))
    first, again = digit(key, 8) % DELIVERIES, digit(key, 9) < 8
    for number in range(DELIVERIES):
        here = rows.where(first == number)
        yield here.unionByName(rows.where(again & (first < number))) if number else here.unionByName(here.where(again))


def _running(spark, sf_dir, files_per_batch):
    """The running table after each delivery, which is one batch or several."""
    source = new_path(spark, "incoming")
    running = streaming.RunningAccuracies(spark, new_path(spark, "running"))
    for number, rows in enumerate(deliveries(spark, sf_dir)):
        rows.write.parquet(f"{source}/delivery={number}")
        running.drain(streaming.read_predictions(spark, f"{source}/*", rows.schema, files_per_batch))
        yield number, running


@query("results_stream", sql(f"""
SELECT {G5}, round(base, 6) AS base, round(extra, 6) AS extra, round(test, 6) AS test, round(majority, 6) AS majority
FROM accuracies""", *ACC))
def results_stream(spark, sf_dir):
    """The table after the last of several deliveries with repeated rows: equal to the accuracies of all rows."""
    *_, (_, running) = _running(spark, sf_dir, 64)
    return running.accuracies().select(*KEYS, *[r6(c).alias(c) for c in (*ARMS, "majority")])


@query("results_stream_running", sql(f"""
, by_label AS (
  SELECT x.delivery, num_train, num_test, lm_type, dataset, subsample_idx, label, CAST(count(*) AS DOUBLE) AS n,
         CAST(count(*) FILTER (WHERE pred_base = label) AS DOUBLE) AS base, CAST(count(*) FILTER (WHERE pred_extra = label) AS DOUBLE) AS extra,
         CAST(count(*) FILTER (WHERE pred_test = label) AS DOUBLE) AS test
  FROM range({DELIVERIES}) AS x(delivery) JOIN delivered AS d ON d.delivery <= x.delivery GROUP BY ALL)
SELECT CAST(delivery AS INTEGER) AS delivery, {G5}, round(sum(base) / sum(n), 6) AS base, round(sum(extra) / sum(n), 6) AS extra,
       round(sum(test) / sum(n), 6) AS test, round(max(n) / sum(n), 6) AS majority
FROM by_label GROUP BY delivery, {G5}""", "predictions", "delivered"))
def results_stream_running(spark, sf_dir):
    """The table after each delivery."""
    looks = [
        stored(running.accuracies(), "look").withColumn("delivery", F.lit(number)) for number, running in _running(spark, sf_dir, 4)]
    return reduce(DataFrame.unionByName, looks).select("delivery", *KEYS, *[r6(c).alias(c) for c in (*ARMS, "majority")])


@query("pca_experiment")
def pca_experiment(spark, sf_dir):
    data, replicates, m, n = vectors(spark, sf_dir), 50, 50, 100
    drawn = replicate_splits(data, m, n, replicates, stratify=False)
    bars = regression.error_bars(regression.pca_r2(data, drawn, replicates * (m + 2 * n)))
    return bars.withColumns({"mean": r6("mean"), "margin": r6("margin")})


@query("clf_ml")
def clf_ml(spark, sf_dir):
    return regression.logistic_arms(documents(spark, sf_dir)).withColumn("accuracy", r6("accuracy"))
