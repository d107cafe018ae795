"""Queries on points in time, splits, labelled sets and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import f1_score, hypergeometric_confidence, ratio_or_zero
from ..operators import clean as C
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import points as P
from ..plans import evaluation as J
from ..plans import views as V
from ..session import scratch_path, stored
from ..sources import categories as cat
from .datasets import BALANCES, _examples, _examples_sql
from .labels import CATEGORIES_SQL, GROUPS, _emerging_sql
from .registry import query
from .sqlviews import ACCT, SCORES, TXN_LONG, TXN_SHORT, with_views

HORIZONS = (1, 3, 7)
SEEDS = (42, 7)
SIZES = (200, -1)

CAL_SQL = """
days AS (SELECT DISTINCT "accountId" AS account_id, date_diff('day', DATE '2020-01-01', date) AS d FROM txn_long),
spans AS (SELECT account_id, count(*) AS n, min(d) AS first, max(d) AS last FROM days GROUP BY account_id),
hz AS (SELECT unnest([1, 3, 7]) AS "T"),
cutoffs AS (
  SELECT s.account_id, "T",
         CASE WHEN last - first + 1 < 90 THEN 'span' WHEN n < 9 THEN 'active' WHEN n - "T" < 1 THEN 'active'
              ELSE 'kept' END AS status,
         (SELECT list(d ORDER BY d)[n - "T"] FROM days x WHERE x.account_id = s.account_id) AS cut_at, last
  FROM spans s, hz)"""


def _calendars(spark, sf):
    return P.calendars(V.txn_long(spark, sf))


@query(
    "negative_cutoffs",
    "account_id:s T:i status:s cutoff_day:i",
    with_views(TXN_LONG, CAL_SQL)
    + """ SELECT account_id, "T", status, CASE WHEN status = 'kept' THEN cut_at END AS cutoff_day FROM cutoffs""",
)
def negative_cutoffs(spark, sf):
    return P.negative_cutoffs(_calendars(spark, sf), HORIZONS)


@query(
    "negative_cutoffs_calendar",
    "account_id:s T:i status:s cutoff_day:i",
    with_views(TXN_LONG, CAL_SQL)
    + """ SELECT account_id, "T", status, CASE WHEN status = 'kept' THEN last - "T" END AS cutoff_day FROM cutoffs""",
)
def negative_cutoffs_calendar(spark, sf):
    return P.negative_cutoffs(_calendars(spark, sf), HORIZONS, calendar_days=True)


@query(
    "eligibility_counts",
    "T:i status:s n:i",
    with_views(TXN_LONG, CAL_SQL) + ' SELECT "T", status, count(*) AS n FROM cutoffs GROUP BY ALL',
)
def eligibility_counts(spark, sf):
    return P.skip_counts(P.negative_cutoffs(_calendars(spark, sf), HORIZONS))


def _dup_flags(spark, sf):
    t = V.txn_long(spark, sf)
    return t.select(
        F.concat_ws("_", F.lit("B"), "accountId").alias("global_id"),
        F.col("subCategoryId").alias("flag_name"),
        F.col("date").alias("emerging_date"),
        F.col("id").cast("long").alias("line"),
    )


EVENTS_SQL = """
ev AS (SELECT 'B_' || "accountId" AS account_id, "subCategoryId" AS flag,
              date_diff('day', DATE '2020-01-01', arg_max(date, CAST(id AS BIGINT))) AS event_day
       FROM txn_long GROUP BY ALL)"""


@query(
    "event_lookup",
    "account_id:s flag:s event_day:i",
    with_views(TXN_LONG, EVENTS_SQL) + " SELECT * FROM ev",
)
def event_lookup(spark, sf):
    return P.event_days(_dup_flags(spark, sf), ["line"])


@query(
    "positive_cutoffs",
    "account_id:s flag:s T:i cutoff_day:i",
    with_views(TXN_LONG, EVENTS_SQL)
    + ' SELECT account_id, flag, "T", event_day - "T" AS cutoff_day FROM ev, (SELECT unnest([1, 3, 7]) AS "T")',
)
def positive_cutoffs(spark, sf):
    return P.positive_cutoffs(P.event_days(_dup_flags(spark, sf), ["line"]), HORIZONS)


@query(
    "sliced_examples",
    "account_id:s T:i day_offset:i",
    with_views(TXN_LONG, CAL_SQL)
    + """, c AS (SELECT account_id, "T", CASE WHEN CAST(account_id AS BIGINT) % 10 = 0 THEN -100000 ELSE cut_at END AS cut_at
                 FROM cutoffs WHERE status = 'kept')
      SELECT c.account_id, "T", d AS day_offset FROM c JOIN days USING (account_id) JOIN spans USING (account_id)
      WHERE d <= cut_at OR (cut_at < first AND d = first)""",
)
def sliced_examples(spark, sf):
    """Up to the cutoff; with nothing before it, the first day alone."""
    cal = _calendars(spark, sf)
    ex = cal.select(
        "account_id", F.transform("day_dates", lambda d: F.struct(d.alias("day_offset"))).alias("days")
    )
    cuts = P.negative_cutoffs(cal, HORIZONS).filter("status = 'kept'").withColumn(
        "cutoff_day", F.when(F.col("account_id").cast("long") % 10 == 0, -100000).otherwise(F.col("cutoff_day"))
    )
    return P.slice_examples(ex, cuts).select("account_id", "T", F.inline("days"))


@query(
    "baseline_features",
    "account_id:s txn_count:i n_days:i total_debit:f3 total_credit:f3 avg_debit:f4 n_large:i "
    + " ".join(f"bal_{c}:f3" for c in BALANCES),
    "WITH rows AS ("
    + _examples_sql("arrival")
    + """), cut AS (SELECT account_id, max(day_offset) - 5 AS at, min(day_offset) AS first FROM rows GROUP BY account_id),
      kept_rows AS (SELECT r.* FROM rows r JOIN cut c ON r.account_id = c.account_id AND r.day_offset <= c.at)
      SELECT account_id, count(*) AS txn_count, count(DISTINCT day_offset) AS n_days,
             coalesce(sum(amount_std) FILTER (amount_std < 0), 0) AS total_debit,
             coalesce(sum(amount_std) FILTER (amount_std > 0), 0) AS total_credit,
             coalesce(avg(amount_std) FILTER (amount_std < 0), 0) AS avg_debit,
             count(*) FILTER (amount_std < -500) AS n_large,
             """
    + ", ".join(f"arg_max(bal_{c}, day_offset) AS bal_{c}" for c in BALANCES)
    + """
      FROM (SELECT * REPLACE (CAST(amount_std AS DOUBLE) AS amount_std) FROM kept_rows) GROUP BY account_id""",
)
def baseline_features(spark, sf):
    ex = _examples(spark, sf)
    cuts = ex.select("account_id", (F.element_at("days", -1)["day_offset"] - 5).alias("cutoff_day"))
    f = P.baseline_features(P.slice_examples(ex, cuts))
    names = ["txn_count", "n_days", "total_debit", "total_credit", "avg_debit", "n_large"]
    return f.select(
        "account_id", *[F.col("features")[i].alias(n) for i, n in enumerate(names)],
        *[F.col("features")[6 + i].alias(f"bal_{c}") for i, c in enumerate(BALANCES)],
    )


@query(
    "baseline_features_raw",
    "accountId:s txn_count:i n_days:i total_debit:f2 total_credit:f2 avg_debit:f9 n_large_debits:i",
    with_views(TXN_SHORT)
    + """ SELECT "accountId", count(amount) AS txn_count, count(DISTINCT date) AS n_days,
             coalesce(sum(amount) FILTER (amount < 0), 0) AS total_debit,
             coalesce(sum(amount) FILTER (amount > 0), 0) AS total_credit,
             coalesce(avg(amount) FILTER (amount < 0), 0) AS avg_debit,
             count(*) FILTER (amount < -500) AS n_large_debits FROM txn_short GROUP BY "accountId" """,
)
def baseline_features_raw(spark, sf):
    return P.baseline_aggregates(V.txn_short(spark, sf))


@query(
    "last_balance_vector",
    "account_id:s " + " ".join(f"bal_{c}:f3" for c in BALANCES),
    "WITH rows AS ("
    + _examples_sql("arrival")
    + ") SELECT account_id, "
    + ", ".join(f"arg_max(bal_{c}, day_offset) AS bal_{c}" for c in BALANCES)
    + " FROM rows GROUP BY account_id",
)
def last_balance_vector(spark, sf):
    from ..operators.examples import explode_examples

    last = P.last_balance_vector(explode_examples(_examples(spark, sf)))
    return last.select("account_id", *[F.col("balance")[i].alias(f"bal_{c}") for i, c in enumerate(BALANCES)])


SPLIT_SQL = """
acc AS (SELECT DISTINCT "accountId" AS account_id FROM txn_long),
seeds AS (SELECT unnest([42, 7]) AS seed),
ranked AS (
  SELECT account_id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(account_id || '|' || seed), account_id) AS r,
         count(*) OVER (PARTITION BY seed) AS n FROM acc, seeds),
split AS (
  SELECT account_id, seed, r, n - ceil(n * CAST(0.3 AS DOUBLE)) AS n_train,
         CASE WHEN r <= n - ceil(n * CAST(0.3 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM ranked)"""


def _accounts(spark, sf):
    return V.txn_long(spark, sf).select(F.col("accountId").alias("account_id")).distinct()


@query(
    "train_val_split",
    "account_id:s split:s",
    with_views(TXN_LONG)
    + """, r AS (SELECT account_id, row_number() OVER (ORDER BY md5(account_id || '|42')) AS r, count(*) OVER () AS n
                 FROM (SELECT DISTINCT "accountId" AS account_id FROM txn_long))
      SELECT account_id, CASE WHEN r <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM r""",
)
def train_val_split(spark, sf):
    return E.train_val_split(_accounts(spark, sf), seed=42)


@query("train_val_split_saved", "split:s n:i", with_views(TXN_LONG) + """
  , c AS (SELECT count(DISTINCT "accountId") AS n FROM txn_long)
  SELECT 'train' AS split, floor(n * CAST(0.9 AS DOUBLE)) AS n FROM c
  UNION ALL SELECT 'val', n - floor(n * CAST(0.9 AS DOUBLE)) FROM c""")
def train_val_split_saved(spark, sf):
    from ..sources.sinks import save_table

    path = scratch_path(spark, "split")
    save_table(train_val_split(spark, sf), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "train_test_split",
    "account_id:s seed:i split:s",
    with_views(TXN_LONG, SPLIT_SQL) + " SELECT account_id, seed, split FROM split",
)
def train_test_split(spark, sf):
    return E.train_test_split(_accounts(spark, sf), SEEDS)


DRAWN_SQL = """
sizes AS (SELECT unnest([200, -1]) AS negatives_in_training),
drawn AS (
  SELECT account_id, seed, negatives_in_training FROM split, sizes
  WHERE split = 'train' AND (negatives_in_training <= 0 OR n_train <= negatives_in_training OR r <= negatives_in_training))"""


@query(
    "subsampled_negatives",
    "account_id:s seed:i negatives_in_training:i",
    with_views(TXN_LONG, SPLIT_SQL, DRAWN_SQL) + " SELECT * FROM drawn",
)
def subsampled_negatives(spark, sf):
    return E.subsample_negatives(E.train_test_split(_accounts(spark, sf), SEEDS), SIZES)


FLAGS_SQL = """
fl AS (SELECT DISTINCT "accountId" AS account_id, flag_name AS flag FROM emerging),
flags AS (SELECT DISTINCT flag FROM fl)"""
_BASE = (TXN_LONG, ACCT, CATEGORIES_SQL, _emerging_sql("txn_long"), FLAGS_SQL)


def _ledger(spark, sf):
    """Transactions written once, and what the evaluation reads from them: events, calendars."""
    txns = stored(V.txn_long(spark, sf), "transactions")
    found = L.detect_emerging(C.filter_accounts(txns, V.acct(spark, sf)), cat.default_categories(spark), GROUPS, 3)
    events = found.select(F.col("accountId").alias("account_id"), F.col("flag_name").alias("flag")).distinct()
    return txns, stored(events, "events"), stored(P.calendars(txns), "calendars")


def _events(spark, sf):
    return _ledger(spark, sf)[1]


@query(
    "negatives_per_flag",
    "account_id:s flag:s",
    with_views(*_BASE)
    + """ SELECT account_id, flag FROM (SELECT DISTINCT "accountId" AS account_id FROM txn_long), flags
          EXCEPT SELECT account_id, flag FROM fl""",
)
def negatives_per_flag(spark, sf):
    return E.negatives_per_flag(_accounts(spark, sf), _events(spark, sf))


def _keys(spark, sf):
    _, events, calendars = _ledger(spark, sf)
    positives = events.withColumn("T", F.explode(F.array(*[F.lit(t) for t in HORIZONS])))
    negatives = P.negative_cutoffs(calendars, HORIZONS).filter("status = 'kept'").select("account_id", "T")
    return calendars.select("account_id"), events, positives, negatives


TRAIN_SQL = """
train_rows AS (
  SELECT f.account_id, s.seed, z.negatives_in_training, f.flag, h."T", 1 AS label
  FROM fl f JOIN split s ON s.account_id = f.account_id AND s.split = 'train', sizes z, hz h
  UNION ALL
  SELECT d.account_id, d.seed, d.negatives_in_training, g.flag, c."T", 0
  FROM drawn d JOIN cutoffs c ON c.account_id = d.account_id AND c.status = 'kept', flags g
  WHERE NOT EXISTS (SELECT 1 FROM fl f WHERE f.account_id = d.account_id AND f.flag = g.flag)),
train_ok AS (
  SELECT seed, negatives_in_training, flag, "T", count(*) AS n, sum(label) AS n_pos FROM train_rows GROUP BY ALL
  HAVING count(*) >= 50 AND sum(label) >= 10)"""


@query(
    "training_rows",
    "account_id:s seed:i negatives_in_training:i flag:s T:i label:i",
    with_views(*_BASE, CAL_SQL, SPLIT_SQL, DRAWN_SQL, TRAIN_SQL)
    + ' SELECT r.* FROM train_rows r SEMI JOIN train_ok USING (seed, negatives_in_training, flag, "T")',
)
def training_rows(spark, sf):
    accounts, events, pos, neg = _keys(spark, sf)
    return E.training_rows(E.train_test_split(accounts, SEEDS), pos, neg, events, SIZES)


@query(
    "usable_runs",
    "seed:i negatives_in_training:i flag:s T:i n:i n_pos:i",
    with_views(*_BASE, CAL_SQL, SPLIT_SQL, DRAWN_SQL, TRAIN_SQL) + " SELECT * FROM train_ok",
)
def usable_runs(spark, sf):
    accounts, events, pos, neg = _keys(spark, sf)
    return E.usable_runs(*E.key_sets(E.train_test_split(accounts, SEEDS), pos, neg, events), SIZES)


TEST_SQL = """
test_rows AS (
  SELECT f.account_id, s.seed, f.flag, h."T", 1 AS label
  FROM fl f JOIN split s ON s.account_id = f.account_id AND s.split = 'test', hz h
  UNION ALL
  SELECT s.account_id, s.seed, g.flag, c."T", 0
  FROM split s JOIN cutoffs c ON c.account_id = s.account_id AND c.status = 'kept', flags g
  WHERE s.split = 'test' AND NOT EXISTS (SELECT 1 FROM fl f WHERE f.account_id = s.account_id AND f.flag = g.flag))"""


@query(
    "test_rows",
    "account_id:s seed:i flag:s T:i label:i",
    with_views(*_BASE, CAL_SQL, SPLIT_SQL, TEST_SQL) + " SELECT * FROM test_rows",
)
def test_rows(spark, sf):
    accounts, events, pos, neg = _keys(spark, sf)
    return E.test_rows(E.train_test_split(accounts, SEEDS), pos, neg, events)


def _vectors(txns):
    """An account's vectors: number, sum and mean of amounts; and its transactions by day of the week, with their number."""
    n = F.count(F.lit(1))
    days = [F.count(F.when(F.dayofweek("date") == d, 1)) for d in range(1, 8)]
    double = lambda *c: F.array(*[x.cast("double") for x in c])
    return txns.groupBy(F.col("accountId").alias("account_id")).agg(
        double(n, F.sum("amount") / 1e6, F.avg("amount") / 1e5).alias("embedding"), double(n, *days).alias("features")
    )


VECTOR_SQL = """
vectors AS (
  SELECT "accountId" AS account_id, CAST(count(*) AS DOUBLE) AS e0, sum(amount) / 1e6 AS e1, avg(amount) / 1e5 AS e2,
         count(*) FILTER (dayofweek(date) = 0) AS sundays, count(*) FILTER (dayofweek(date) = 6) AS saturdays
  FROM txn_long GROUP BY ALL)"""


def _evaluation_inputs(spark, sf):
    txns, events, calendars = _ledger(spark, sf)
    vectors = stored(_vectors(txns), "vectors")
    positives = events.withColumn("T", F.explode(F.array(*[F.lit(t) for t in HORIZONS]))).join(vectors, "account_id")
    negatives = P.negative_cutoffs(calendars, HORIZONS).filter("status = 'kept'").select("account_id", "T")
    return calendars.select("account_id"), positives, negatives.join(vectors, "account_id"), events


@query(
    "evaluation_rows",
    "kind:s account_id:s seed:i T:i split:s train_rank:i n_train:i flags:s e0:f6 e1:f6 e2:f6 sundays:i saturdays:i",
    with_views(*_BASE, CAL_SQL, SPLIT_SQL, VECTOR_SQL)
    + """, keyed AS (
       SELECT 'negative' AS kind, c.account_id, "T", (SELECT string_agg(flag, ',' ORDER BY flag) FROM fl f WHERE f.account_id = c.account_id) AS flags
       FROM cutoffs c WHERE status = 'kept'
       UNION ALL SELECT 'positive', account_id, "T", flag FROM fl, hz)
     SELECT kind, k.account_id, seed, "T", split, CASE WHEN split = 'train' THEN r END AS train_rank, n_train,
            coalesce(flags, '') AS flags, e0, e1, e2, sundays, saturdays
     FROM keyed k JOIN split USING (account_id) JOIN vectors USING (account_id)""",
)
def evaluation_rows(spark, sf):
    """The stored rows that every run of the evaluation is a filter of, with their vectors."""
    accounts, positives, negatives, events = _evaluation_inputs(spark, sf)
    out = scratch_path(spark, "evaluation-rows")
    candidates, known = J.evaluation_rows(E.train_test_split(accounts, SEEDS), positives, negatives, events, out)
    both = candidates.withColumns({"kind": F.lit("negative"), "flags": F.array_join("flags", ",")}).unionByName(
        known.withColumnRenamed("flag", "flags").withColumn("kind", F.lit("positive"))
    )
    numbers = {f"e{i}": F.col("embedding")[i] for i in range(3)} | {"sundays": F.col("features")[1], "saturdays": F.col("features")[7]}
    return both.withColumns(numbers)


def _count_score(train, test, seed, methods, trees):
    """A score that needs no fit: how many transactions the account has."""
    return test.select(F.lit("Count").alias("method"), "id", "label", (F.col("embedding")[0] / 64).alias("score"))


@query("positives_in_train",
    "account_id:s seed:i flag:s",
    with_views(*_BASE, SPLIT_SQL)
    + " SELECT f.account_id, seed, flag FROM fl f JOIN split s ON s.account_id = f.account_id WHERE split = 'train'",
)
def positives_in_train(spark, sf):
    train = E.train_test_split(_accounts(spark, sf), SEEDS).filter("split = 'train'").select("account_id", "seed")
    return _events(spark, sf).join(train, "account_id")


@query(
    "class_weights",
    "grp:s n_pos:i n_neg:i scale_pos_weight:f6 weight_pos:f6 weight_neg:f6",
    with_views(SCORES)
    + """, c AS (SELECT grp, sum(label) AS p, sum(1 - label) AS q FROM scores GROUP BY grp)
      SELECT grp, p AS n_pos, q AS n_neg, coalesce(q / CAST(nullif(p, 0) AS DOUBLE), 1) AS scale_pos_weight,
             (p + q) / CAST(nullif(2 * p, 0) AS DOUBLE) AS weight_pos,
             (p + q) / CAST(nullif(2 * q, 0) AS DOUBLE) AS weight_neg FROM c""",
)
def class_weights(spark, sf):
    return E.class_weights(V.scores(spark, sf), ["grp"])


RANKED_SQL = """
rk AS (
  SELECT *, row_number() OVER w AS rank, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS found,
         count(*) OVER (PARTITION BY grp) AS n_total, sum(label) OVER (PARTITION BY grp) AS n_pos
  FROM scores WINDOW w AS (PARTITION BY grp ORDER BY score DESC, id))"""


@query(
    "score_ranks",
    "grp:s id:s rank:i found:i n_total:i n_pos:i",
    with_views(SCORES, RANKED_SQL) + " SELECT * FROM rk",
)
def score_ranks(spark, sf):
    return E.ranked_scores(V.scores(spark, sf), ["grp"])


@query(
    "top_five_percent",
    "grp:s id:s rank:i",
    with_views(SCORES, RANKED_SQL) + " SELECT * FROM rk WHERE rank <= greatest(1, floor(n_total * 5.0 / 100.0))",
)
def top_five_percent(spark, sf):
    return E.top_share(V.scores(spark, sf), ["grp"], 5)


def _ln_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


CONF_SQL = (
    "CASE WHEN found = 0 OR n_pos = 0 THEN 0 ELSE 100 * (1 - coalesce(list_sum(list_transform("
    "range(CAST(greatest(found, rank + n_pos - n_total) AS BIGINT), CAST(least(n_pos, rank) AS BIGINT) + 1), "
    f"lambda x: exp({_ln_choose('n_pos', 'x')} + {_ln_choose('(n_total - n_pos)', '(rank - x)')}"
    f" - {_ln_choose('n_total', 'rank')}))), 0)) END"
)


def _at_k_sql(ks: str) -> str:
    return f"""
ks AS (SELECT unnest({ks}) AS k_pct),
at_k AS (
  SELECT rk.*, k_pct, n_pos / CAST(n_total AS DOUBLE) AS prevalence, found / CAST(rank AS DOUBLE) AS prec,
         found / CAST(n_pos AS DOUBLE) AS rec, {CONF_SQL} AS confidence
  FROM rk, ks WHERE rank = greatest(1, floor(n_total * k_pct / 100.0)))"""


_F1 = "CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END"


LIFT_NAMES = {
    "lift": ("prec / prevalence", "f6"), "conf": ("confidence", "f5"), "recall": ("rec", "f6"), "precision": ("prec", "f6"),
    "f1": (_F1, "f6"), "n_found": ("found", "i"), "depth": ("rank", "i"),
}
LIFT_SHAPE = " ".join(f"{n}_{k}:{kind}" for n, (_, kind) in LIFT_NAMES.items() for k in E.LIFT_KS)
LIFT_PICKS = ", ".join(
    f"max(CASE WHEN n_pos > 0 THEN {value} ELSE 0 END) FILTER (k_pct = {k}) AS {n}_{k}" for n, (value, _) in LIFT_NAMES.items() for k in E.LIFT_KS
)
LIFT_KS_SQL = "[" + ", ".join(f"{float(k)}" for k in E.LIFT_KS) + "]::DOUBLE[]"


@query(
    "lift_table",
    "grp:s n_pos:i n_total:i prevalence:f6 " + LIFT_SHAPE,
    with_views(SCORES, RANKED_SQL, _at_k_sql(LIFT_KS_SQL))
    + f""" SELECT grp, any_value(n_pos) AS n_pos, any_value(n_total) AS n_total, any_value(prevalence) AS prevalence, {LIFT_PICKS}
     FROM at_k GROUP BY grp""",
)
def lift_table(spark, sf):
    return E.lift_table(V.scores(spark, sf), ["grp"])


@query(
    "granular_curve",
    "grp:s k_pct:f4 depth:i n_pos_at_k:i n_total:i n_pos_total:i lift:f6 recall:f6 precision:f6 f1:f6 confidence:f5",
    with_views(
        SCORES,
        RANKED_SQL,
        _at_k_sql(
            "list_concat(list_transform(range(30), lambda i: CAST(0.1 AS DOUBLE) + i * CAST(0.1 AS DOUBLE)), "
            "list_transform(range(4, 101), lambda k: CAST(k AS DOUBLE)))"
        ),
    )
    + f""" SELECT grp, k_pct, rank AS depth, found AS n_pos_at_k, n_total, n_pos AS n_pos_total,
             prec / prevalence AS lift, rec AS recall, prec AS precision, {_F1} AS f1, confidence FROM at_k""",
)
def granular_curve(spark, sf):
    return E.granular_curve(V.scores(spark, sf), ["grp"])


@query(
    "rank_metric_arithmetic",
    "grp:s precision:f6 recall:f6 f1:f6 lift:f6",
    with_views(SCORES)
    + f""", c AS (SELECT grp, count(*) FILTER (label = 1 AND score > 0.5) / CAST(nullif(count(*) FILTER (score > 0.5), 0) AS DOUBLE) AS prec,
                  count(*) FILTER (label = 1 AND score > 0.5) / CAST(sum(label) AS DOUBLE) AS rec, avg(label) AS base
                FROM scores GROUP BY grp)
      SELECT grp, prec AS precision, rec AS recall, {_F1} AS f1, prec / base AS lift FROM c""",
)
def rank_metric_arithmetic(spark, sf):
    hit = F.col("score") > 0.5
    c = V.scores(spark, sf).groupBy("grp").agg(
        F.count(F.when(hit & (F.col("label") == 1), 1)).alias("tp"),
        F.count(F.when(hit, 1)).alias("k"), F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"),
    )
    precision, recall = ratio_or_zero(F.col("tp"), F.col("k")), ratio_or_zero(F.col("tp"), F.col("p"))
    return c.select(
        "grp", precision.alias("precision"), recall.alias("recall"), f1_score(precision, recall).alias("f1"),
        ratio_or_zero(precision, F.col("p") / F.col("n")).alias("lift"),
    )


@query(
    "hypergeometric_confidence",
    "user_id:i found:i confidence:f5",
    f"""WITH t AS (
          SELECT user_id, count(*) FILTER (event_type = 'click') AS rank_, count(*) FILTER (event_type = 'click' AND value > 20) AS found,
                 count(*) FILTER (value > 20) AS n_pos, count(*) AS n_total FROM events GROUP BY user_id),
        r AS (SELECT user_id, found, n_pos, n_total, rank_ AS rank FROM t)
        SELECT user_id, found, {CONF_SQL} AS confidence FROM r""",
)
def hypergeometric_confidence_of_users(spark, sf):
    """Are a user's large values over-represented among the clicks?"""
    click, big = F.col("event_type") == "click", F.col("value") > 20
    n = lambda c: F.count(F.when(c, 1))
    t = V.table(spark, sf, "events").groupBy("user_id").agg(
        n(click).alias("drawn"), n(click & big).alias("found"), n(big).alias("good"),
        F.count(F.lit(1)).alias("total"),
    )
    return t.select("user_id", "found", hypergeometric_confidence("found", "total", "good", "drawn").alias("confidence"))


AUC_SQL = """
r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY score)
                + (count(*) OVER (PARTITION BY grp, score) - 1) / CAST(2 AS DOUBLE) AS rk FROM scores)"""


@query(
    "roc_auc",
    "grp:s n_pos:i n_neg:i auc:f8",
    with_views(SCORES, AUC_SQL)
    + """, s AS (SELECT grp, sum(label) AS p, sum(1 - label) AS q, sum(rk) FILTER (label = 1) AS rs FROM r GROUP BY grp)
      SELECT grp, p AS n_pos, q AS n_neg, CASE WHEN p > 0 AND q > 0 THEN (rs - p * (p + 1) / 2) / (p * q) ELSE 0.5 END AS auc FROM s""",
)
def roc_auc(spark, sf):
    return E.roc_auc(V.scores(spark, sf), ["grp"])


@query(
    "metric_seed_means",
    "flag:s T:i method:s auc:f8 lift_5:f8 lift_10:f8",
    """SELECT o_orderpriority AS flag, o_custkey % 3 AS "T", o_orderstatus AS method, avg(o_totalprice) AS auc,
              avg(o_totalprice / 7) AS lift_5, avg(o_totalprice / 13) AS lift_10 FROM orders GROUP BY ALL""",
)
def metric_seed_means(spark, sf):
    o = V.table(spark, sf, "orders")
    m = o.select(
        F.col("o_orderpriority").alias("flag"), (F.col("o_custkey") % 3).alias("T"),
        F.col("o_orderstatus").alias("method"), F.col("o_totalprice").alias("auc"),
        (F.col("o_totalprice") / 7).alias("lift_5"), (F.col("o_totalprice") / 13).alias("lift_10"),
    )
    return E.seed_means(m)


@query(
    "metrics_saved",
    "flag:s T:i method:s auc:f8",
    """SELECT o_orderpriority AS flag, o_custkey % 3 AS "T", o_orderstatus AS method, avg(o_totalprice) AS auc
       FROM orders GROUP BY ALL""",
)
def metrics_saved(spark, sf):
    """Metric rows written as one CSV file and read back."""
    from ..sources.sinks import save_metrics
    from ..sources.tables import read_csv

    path = scratch_path(spark, "metrics")
    save_metrics(metric_seed_means(spark, sf), path)
    return read_csv(spark, path)


@query(
    "evaluation_job",
    "seed:i negatives_in_training:i flag:s T:i method:s auc:f8 n_pos:i n_total:i prevalence:f6 " + LIFT_SHAPE,
    with_views(*_BASE, CAL_SQL, SPLIT_SQL, DRAWN_SQL, TRAIN_SQL, TEST_SQL, VECTOR_SQL)
    + """, scores AS (
        SELECT concat_ws('|', o.seed, negatives_in_training, o.flag, o."T") AS grp, account_id AS id, label, e0 / 64 AS score
        FROM test_rows t JOIN train_ok o ON o.seed = t.seed AND o.flag = t.flag AND o."T" = t."T" JOIN vectors USING (account_id)),"""
    + RANKED_SQL + "," + _at_k_sql(LIFT_KS_SQL) + "," + AUC_SQL
    + f""", s AS (SELECT grp, sum(label) AS p, sum(1 - label) AS q, sum(rk) FILTER (label = 1) AS rs FROM r GROUP BY grp),
      auc AS (SELECT grp, CASE WHEN p > 0 AND q > 0 THEN (rs - p * (p + 1) / 2) / (p * q) ELSE 0.5 END AS auc FROM s),
      wide AS (SELECT grp, any_value(n_pos) AS n_pos, any_value(n_total) AS n_total, any_value(prevalence) AS prevalence, {LIFT_PICKS}
               FROM at_k GROUP BY grp)
      SELECT o.seed, o.negatives_in_training, o.flag, o."T", 'Count' AS method, auc, wide.* EXCLUDE (grp)
      FROM train_ok o JOIN wide ON wide.grp = concat_ws('|', o.seed, o.negatives_in_training, o.flag, o."T") JOIN auc USING (grp)""",
)
def evaluation_job(spark, sf):
    """The whole evaluation with a score that needs no fit: every run's metrics."""
    accounts, positives, negatives, events = _evaluation_inputs(spark, sf)
    return J.run_evaluation(
        accounts, positives, negatives, events, seeds=SEEDS, sizes=SIZES, methods=["Count"], score=_count_score
    )
