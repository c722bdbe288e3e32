"""Queries for evaluation, trial logs and ensembles.

The predictions are rules over the orders: the actual label is the priority and
three rules guess it from the price, the month and the day. Each rule also
gives every label a probability that falls with its distance from the guess.
"""

from pyspark.sql import functions as F

from penprint.catalog.base import query, r6, table
from penprint.operators import ensemble, evaluate
from penprint.operators.model import predict_labels

LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
RULES = {
    "day": ("CAST(least(5, ceil(day(o_orderdate) / 6)) AS INTEGER)"),
    "month": ("CAST(ceil(month(o_orderdate) * 5 / 12) AS INTEGER)"),
    "price": ("CAST(least(5, floor(o_totalprice / 100000) + 1) AS INTEGER)"),
}
_NAMES = "['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']"
_TOTALS = {1: 15, 2: 18, 3: 19, 4: 18, 5: 15}

VOTES_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey, o_custkey, o_orderpriority AS actual, '{m}' AS model, {rule} AS g, {_NAMES}[{rule}] AS predicted FROM orders" for m, rule in RULES.items())
PROBABILITIES_SQL = f"""SELECT o_orderkey, model, predicted, {_NAMES}[j] AS label,
    round((5 - abs(g - j)) / CASE g WHEN 1 THEN 15.0::DOUBLE WHEN 2 THEN 18.0::DOUBLE WHEN 3 THEN 19.0::DOUBLE WHEN 4 THEN 18.0::DOUBLE ELSE 15.0::DOUBLE END, 6) AS p
    FROM votes, (SELECT unnest([1, 2, 3, 4, 5]) AS j)"""
WITH = f"WITH votes AS ({VOTES_SQL}), probabilities AS ({PROBABILITIES_SQL})"
PRICE = "(SELECT * FROM votes WHERE model = 'price')"


def votes(spark, sf):
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.expr(rule).alias("g")) for m, rule in RULES.items()]))
    names = F.array(*[F.lit(v) for v in LABELS])
    return (
        table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("actual"), each.alias("_v"))
        .select("o_orderkey", "o_custkey", "actual", "_v.model", "_v.g", F.get(names, F.col("_v.g") - 1).alias("predicted"))
    )


def probabilities(spark, sf):
    total = F.create_map(*[F.lit(v) for kv in _TOTALS.items() for v in kv])
    cells = F.array(*[
        F.struct(F.lit(v).alias("label"), F.round((5 - F.abs(F.col("g") - j)) / total[F.col("g")], 6).alias("p")) for j, v in enumerate(LABELS, 1)
    ])
    return votes(spark, sf).select("o_orderkey", "model", "predicted", F.explode(cells).alias("_c")).select("o_orderkey", "model", "predicted", "_c.*")


def by_price(spark, sf):
    return votes(spark, sf).where(F.col("model") == "price")


def _scores(source: str, by: str = "") -> str:
    """SQL of the per-label scores of a set of predictions."""
    keys = f"{by}, " if by else ""
    return f"""s AS (SELECT {keys}label, sum(tp) AS tp, sum(su) AS su, sum(pr) AS pr FROM (
        SELECT {keys}actual AS label, CAST(actual = predicted AS INTEGER) AS tp, 1 AS su, 0 AS pr FROM {source}
        UNION ALL SELECT {keys}predicted, 0, 0, 1 FROM {source}) GROUP BY ALL),
      m AS (SELECT {keys}label, tp, su, pr, CASE WHEN pr > 0 THEN tp / pr ELSE 0 END AS precision, CASE WHEN su > 0 THEN tp / su ELSE 0 END AS recall,
            CASE WHEN tp > 0 THEN 2 * tp / (pr + su) ELSE 0 END AS f1_score FROM s)"""


def _report(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}label, round(precision * 100, 6) AS precision, round(recall * 100, 6) AS recall, round(f1_score * 100, 6) AS f1_score, CAST(su AS BIGINT) AS support FROM m
      UNION ALL SELECT {keys}'accuracy', round(100 * sum(tp) / sum(su), 6), round(100 * sum(tp) / sum(su), 6), round(100 * sum(tp) / sum(su), 6), CAST(sum(su) AS BIGINT) FROM m {group}
      UNION ALL SELECT {keys}'macro avg', round(100 * avg(precision), 6), round(100 * avg(recall), 6), round(100 * avg(f1_score), 6), CAST(sum(su) AS BIGINT) FROM m {group}
      UNION ALL SELECT {keys}'weighted avg', round(100 * sum(precision * su) / sum(su), 6), round(100 * sum(recall * su) / sum(su), 6),
             round(100 * sum(f1_score * su) / sum(su), 6), CAST(sum(su) AS BIGINT) FROM m {group}"""


def _rounded(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


_MEASURES = ("precision", "recall", "f1_score")


@query(f"{WITH}, {_scores(PRICE)} {_report()}")
def classification_report(spark, sf):
    return _rounded(evaluate.classification_report(by_price(spark, sf), "actual", "predicted"), *_MEASURES)


@query(f"{WITH}, {_scores('votes', 'model')} {_report('model')}")
def classification_report_by_model(spark, sf):
    return _rounded(evaluate.classification_report(votes(spark, sf), "actual", "predicted", ["model"]), *_MEASURES)


def _cells(part: str) -> str:
    return ", ".join(f"""{part.format(v=v)} AS "{v}" """ for v in LABELS)


@query(f"""{WITH} SELECT actual, {_cells("round(count(*) FILTER (WHERE predicted = '{v}') / count(*), 6)")} FROM {PRICE} GROUP BY 1""")
def confusion_matrix(spark, sf):
    return _rounded(evaluate.confusion_matrix(by_price(spark, sf), "actual", "predicted", LABELS), *[f"{v}" for v in LABELS])


@query(f"""{WITH} SELECT actual, {_cells("count(*) FILTER (WHERE predicted = '{v}')")} FROM {PRICE} GROUP BY 1""")
def confusion_matrix_raw(spark, sf):
    return evaluate.confusion_matrix(by_price(spark, sf), "actual", "predicted", LABELS, normalize=False)


@query("""WITH r AS (SELECT p_partkey, unnest(string_split(p_name, ' ') || [p_type]) AS label, 1 AS a, 0 AS p FROM part
                     UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ') || [p_brand]), 0, 1 FROM part),
               c AS (SELECT p_partkey, label, max(a) AS a, max(p) AS p FROM r GROUP BY 1, 2)
          SELECT label, count(*) FILTER (WHERE a = 1 AND p = 1) AS tp, count(*) FILTER (WHERE a = 0) AS fp, count(*) FILTER (WHERE p = 0) AS fn,
                 (SELECT count(*) FROM part) - count(*) AS tn FROM c GROUP BY 1""")
def multilabel_confusion(spark, sf):
    words = F.replace(F.col("p_name"), F.lit(" "), F.lit("; "))
    tagged = table(spark, sf, "part").select(F.concat_ws("; ", words, "p_type").alias("actual"), F.concat_ws("; ", words, "p_brand").alias("predicted"))
    return evaluate.multilabel_confusion(tagged, "actual", "predicted")


@query(f"""{WITH}, {_scores(PRICE)}, t AS (SELECT sum(tp) AS tp, sum(pr) AS pr, sum(su) AS su FROM m WHERE label IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))
           SELECT round(tp / pr, 6) AS precision, round(tp / su, 6) AS recall, round(2 * tp / (pr + su), 6) AS f1_score FROM t""")
def micro_scores(spark, sf):
    return _rounded(evaluate.micro_scores(by_price(spark, sf), "actual", "predicted", LABELS[:3]), *_MEASURES)


@query("""SELECT round(avg(power(l_quantity * 1000 - l_extendedprice, 2)) / 1e6, 3) AS mse, round(sqrt(avg(power(l_quantity * 1000 - l_extendedprice, 2))), 3) AS rmse FROM lineitem""")
def regression_errors(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("guess", F.col("l_quantity") * 1000)
    out = evaluate.regression_errors(rows, "l_extendedprice", "guess")
    return out.select(F.round(F.col("mse") / 1e6, 3).alias("mse"), F.round("rmse", 3).alias("rmse"))


@query(f"""{WITH}, {_scores('votes', 'model')} SELECT model, round(sum(tp) / sum(su), 6) AS accuracy, round(2 * sum(tp) / (sum(pr) + sum(su)), 6) AS f1_micro,
           round(avg(f1_score), 6) AS f1_macro, round(sum(f1_score * su) / sum(su), 6) AS f1_weighted FROM m GROUP BY 1""")
def scheme_scores(spark, sf):
    return _rounded(evaluate.scheme_scores(votes(spark, sf), "actual", "predicted", ["model"]), "accuracy", "f1_micro", "f1_macro", "f1_weighted")


def _voted(column: str, source: str) -> str:
    return f"(SELECT o_custkey, arg_min({column}, (-c, {column})) AS {column} FROM (SELECT o_custkey, {column}, count(*) AS c FROM {source} GROUP BY 1, 2) GROUP BY 1)"


@query(f"{WITH}, authors AS (SELECT * FROM {_voted('actual', PRICE)} JOIN {_voted('predicted', PRICE)} USING (o_custkey)), {_scores('authors')} {_report()}")
def author_report(spark, sf):
    return _rounded(evaluate.author_report(by_price(spark, sf), "o_custkey", "actual", "predicted"), *_MEASURES)


def _trials(spark, sf):
    facts = votes(spark, sf).groupBy("model").agg(F.count_if(F.col("g") == 3).alias("middle"), F.max("g").alias("layers"))
    return facts.withColumn("best", (F.col("model") != "day").cast("int"))


@query(f"""{WITH}, {_scores('votes', 'model')} SELECT model, count(*) FILTER (WHERE g = 3) AS middle, any_value(f1_macro) AS f1_macro, any_value(f1_weighted) AS f1_weighted
           FROM votes JOIN (SELECT model, round(avg(f1_score), 6) AS f1_macro, round(sum(f1_score * su) / sum(su), 6) AS f1_weighted FROM m GROUP BY 1) USING (model) GROUP BY 1""")
def sweep(spark, sf):
    out = evaluate.sweep(votes(spark, sf), _trials(spark, sf), "model", "actual", "predicted")
    return _rounded(out.select("model", "middle", "f1_macro", "f1_weighted"), "f1_macro", "f1_weighted")


@query(f"""{WITH} SELECT model, count(*) FILTER (WHERE g = 3) AS middle FROM votes GROUP BY 1 HAVING max(g) = 5 ORDER BY 2 DESC, 1 LIMIT 1""")
def best_trial(spark, sf):
    return evaluate.best_trial(_trials(spark, sf), "middle", {"layers": 5}).select("model", "middle")


@query(f"""{WITH} SELECT layers, arg_max(model, middle) AS model, max(middle) AS middle FROM
           (SELECT model, max(g) AS layers, count(*) FILTER (WHERE g = 3) AS middle FROM votes WHERE model <> 'day' GROUP BY 1) GROUP BY 1""")
def flagged_trial(spark, sf):
    return evaluate.flagged_trial(_trials(spark, sf), "layers", "best", "middle").select("layers", "model", "middle")


@query(f"""{WITH}, {_scores('votes', 'model')}, r AS ({_report('model')})
           SELECT model AS feature_set, label, round(f1_score, 4) AS f1_score, rank() OVER (PARTITION BY label ORDER BY round(f1_score, 4) DESC) = 1 AS best FROM r""")
def leaderboard(spark, sf):
    reports = classification_report_by_model(spark, sf).withColumnRenamed("model", "feature_set")
    return evaluate.leaderboard(reports)


@query(f"""{WITH}, {_scores('votes', 'model')}, r AS ({_report('model')})
           SELECT model AS feature_set, {", ".join(f"round(max(f1_score) FILTER (WHERE label = '{v}'), 4) AS " + '"' + v + '"' for v in (*LABELS, "macro avg"))} FROM r GROUP BY 1""")
def wide_leaderboard(spark, sf):
    reports = classification_report_by_model(spark, sf).withColumnRenamed("model", "feature_set")
    return evaluate.wide_leaderboard(reports, [*LABELS, "macro avg"])


# --- Ensembles ---------------------------------------------------------------------------
_WINNER = "SELECT o_orderkey, arg_min({c}, (-w, {c})) AS predicted FROM ({inner}) GROUP BY 1"


@query(f"{WITH} " + _WINNER.format(c="predicted", inner="SELECT o_orderkey, predicted, count(*) AS w FROM votes GROUP BY 1, 2"))
def ensemble_mode(spark, sf):
    return ensemble.ensemble_mode(votes(spark, sf), "o_orderkey")


_WEIGHTS = f"""{_scores('votes', 'model')}, f AS (SELECT model, sum(f1_score * su) / sum(su) AS fw FROM m GROUP BY 1),
    weights AS (SELECT model, fw / sum(fw) OVER () AS weight FROM f)"""
_WEIGHTED = _WINNER.format(c="predicted", inner="SELECT o_orderkey, predicted, round(sum(weight), 12) AS w FROM votes JOIN weights USING (model) GROUP BY 1, 2")


@query(f"{WITH}, {_WEIGHTS} SELECT model, round(weight, 6) AS weight FROM weights")
def ensemble_weights(spark, sf):
    return _rounded(ensemble.ensemble_weights(votes(spark, sf), "model", "actual"), "weight")


def _weighted(spark, sf):
    given = votes(spark, sf)
    return ensemble.ensemble_weighted(given, ensemble.ensemble_weights(given, "model", "actual"), "o_orderkey", "model")


@query(f"{WITH}, {_WEIGHTS} {_WEIGHTED}")
def ensemble_weighted(spark, sf):
    return _weighted(spark, sf)


@query(f"{WITH} " + _WINNER.format(c="label", inner="SELECT o_orderkey, label, round(avg(p), 12) AS w FROM probabilities GROUP BY 1, 2"))
def ensemble_mean(spark, sf):
    return ensemble.ensemble_mean(probabilities(spark, sf), "o_orderkey")


@query(f"{WITH} " + _WINNER.format(c="label", inner="SELECT o_orderkey, label, max(p) AS w FROM probabilities GROUP BY 1, 2"))
def ensemble_highest(spark, sf):
    return ensemble.ensemble_highest(probabilities(spark, sf), "o_orderkey")


@query(f"""{WITH}, {_WEIGHTS}, winners AS ({_WEIGHTED})
           SELECT o_orderkey, label, round(avg(p), 6) AS p FROM probabilities JOIN winners USING (o_orderkey, predicted) GROUP BY 1, 2""")
def vote_probabilities(spark, sf):
    out = ensemble.vote_probabilities(
        _weighted(spark, sf), votes(spark, sf), probabilities(spark, sf).drop("predicted"), "o_orderkey", "model")
    return _rounded(out, "p")


@query(f"{WITH} SELECT o_orderkey, round(avg(g), 6) AS g FROM votes GROUP BY 1")
def ensemble_regression(spark, sf):
    return _rounded(ensemble.ensemble_regression(votes(spark, sf), "o_orderkey", "g"), "g")


@query(f"""{WITH}, a AS (SELECT o_orderkey, model, list(p ORDER BY label) AS ps FROM probabilities GROUP BY 1, 2)
           SELECT o_orderkey, model, {_NAMES}[list_position(ps, list_max(ps))] AS predicted,
                  CASE WHEN ps[1] >= 0.5 THEN 'yes' ELSE 'no' END AS binary FROM a""")
def labels_from_probabilities(spark, sf):
    listed = probabilities(spark, sf).groupBy("o_orderkey", "model").agg(F.array_sort(F.collect_list(F.struct("label", "p"))).alias("_c")).select(
        "o_orderkey", "model", F.col("_c.p").alias("ps"))
    out = predict_labels(listed, "ps", LABELS).withColumn("one", F.slice("ps", 1, 1))
    return predict_labels(out, "one", ["no", "yes"], name="binary").select("o_orderkey", "model", "predicted", "binary")
