"""Queries on vocabularies, nested examples, padding and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.scalars import date_features, month_and_weekend
from ..operators import augment as A
from ..operators import balance as B
from ..operators import clean as C
from ..operators import examples as X
from ..operators import vocab as Vc
from ..plans import views as V
from ..plans.dataset import build_dataset, build_flag_examples
from ..session import ensure_checkpoint_dir, scratch_path, stored
from ..sources import sinks as S
from .registry import query
from .sqlviews import LEDGER_SHORT, TXN_LONG, TXN_SHORT, with_views

# The library's defaults; where a cap is what a query shows, it takes one that bites on the test tables.
MAX_DAYS, MAX_TXNS, MIN_DAYS = 180, 20, 9
FEW_DAYS, FEW_TXNS, MANY_DAYS = 20, 2, 25
COLS = {"cat_group": "categoryGroupId", "cat_sub": "subCategoryId", "cat_cp": "counter_party"}

VOCAB_SQL = """
tokens AS (
  SELECT DISTINCT feature, token FROM (
    SELECT 'cat_group' AS feature, "categoryGroupId" AS token FROM txn_short
    UNION ALL SELECT 'cat_sub', "subCategoryId" FROM txn_short
    UNION ALL SELECT 'cat_cp', counter_party FROM txn_short)
  WHERE token IS NOT NULL AND token <> ''),
vocab AS (SELECT feature, token, row_number() OVER (PARTITION BY feature ORDER BY token) + 1 AS token_id FROM tokens)"""


def _vocab(spark, sf):
    return Vc.build_vocab(V.txn_short(spark, sf), COLS)


@query("vocabulary", "feature:s token:s token_id:i", with_views(TXN_SHORT, VOCAB_SQL) + " SELECT * FROM vocab")
def vocabulary(spark, sf):
    return _vocab(spark, sf)


@query(
    "vocabulary_of_words",
    "feature:s token:s token_id:i",
    """WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS token FROM documents)
       SELECT 'word' AS feature, token, row_number() OVER (ORDER BY token) + 1 AS token_id FROM w WHERE token <> ''""",
)
def vocabulary_of_words(spark, sf):
    """A large vocabulary: every word of every text, ranked in chunks."""
    words = V.table(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("word"))
    return Vc.build_vocab(words, {"word": "word"}, rows_per_chunk=20_000)


@query(
    "vocabulary_sizes",
    "feature:s n_tokens:i",
    with_views(TXN_SHORT, VOCAB_SQL) + " SELECT feature, count(*) + 2 AS n_tokens FROM vocab GROUP BY feature",
)
def vocabulary_sizes(spark, sf):
    return Vc.vocab_sizes(_vocab(spark, sf))


@query(
    "vocabulary_saved",
    "feature:s token:s token_id:i",
    with_views(TXN_SHORT, VOCAB_SQL) + " SELECT * FROM vocab",
)
def vocabulary_saved(spark, sf):
    path = scratch_path(spark, "vocab")
    S.save_table(_vocab(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "distinct_tokens",
    "feature:s token:s",
    with_views(TXN_SHORT, VOCAB_SQL) + " SELECT * FROM tokens",
)
def distinct_tokens(spark, sf):
    return Vc.distinct_tokens(V.txn_short(spark, sf), COLS)


ODD_SQL = """,
odd AS (SELECT id, "categoryGroupId",
               CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN NULL WHEN CAST(id AS BIGINT) % 5 = 1 THEN ''
                    WHEN CAST(id AS BIGINT) % 5 = 2 THEN 'never seen' ELSE "subCategoryId" END AS sub,
               counter_party FROM txn_short)"""


@query(
    "encoded_tokens",
    "id:s cat_group:i cat_sub:i cat_cp:i",
    with_views(TXN_SHORT, VOCAB_SQL)
    + ODD_SQL
    + """ SELECT id, coalesce(g.token_id, 1) AS cat_group,
                 CASE WHEN sub IS NULL OR sub = '' THEN 0 ELSE coalesce(s.token_id, 1) END AS cat_sub,
                 CASE WHEN counter_party IS NULL OR counter_party = '' THEN 0 ELSE coalesce(c.token_id, 1) END AS cat_cp
          FROM odd LEFT JOIN vocab g ON g.feature = 'cat_group' AND g.token = "categoryGroupId"
          LEFT JOIN vocab s ON s.feature = 'cat_sub' AND s.token = sub
          LEFT JOIN vocab c ON c.feature = 'cat_cp' AND c.token = counter_party""",
)
def encoded_tokens(spark, sf):
    n = F.col("id").cast("long") % 5
    odd = V.txn_short(spark, sf).withColumn(
        "sub", F.when(n == 1, "").when(n == 2, "never seen").when(n > 2, F.col("subCategoryId"))
    )
    return Vc.encode(odd, _vocab(spark, sf), {**COLS, "cat_sub": "sub"})


@query(
    "decoded_tokens",
    "event_id:i token:s",
    with_views(TXN_SHORT, VOCAB_SQL)
    + """ SELECT event_id, CASE WHEN event_id % 12 = 0 THEN '<PAD>' ELSE coalesce(token, '<UNK>') END AS token
          FROM events LEFT JOIN vocab ON feature = 'cat_sub' AND token_id = event_id % 12""",
)
def decoded_tokens(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", (F.col("event_id") % 12).alias("tid"))
    return Vc.decode(e, _vocab(spark, sf), "cat_sub", "tid")


@query(
    "date_features",
    "id:s dow:i dom:i mon:i years:f5 month:i is_weekend:i",
    with_views(TXN_LONG)
    + """ SELECT id, isodow(date) - 1 AS dow, day(date) - 1 AS dom, month(date) - 1 AS mon,
             CAST(date_diff('day', DATE '2020-01-01', date) / CAST(365 AS DOUBLE) AS FLOAT) AS years,
             month(date) AS month, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM txn_long""",
)
def date_features_of_rows(spark, sf):
    f = date_features(F.col("date"))
    month, weekend = month_and_weekend(F.col("date"))
    return V.txn_long(spark, sf).select(
        "id", f[0].alias("dow"), f[1].alias("dom"), f[2].alias("mon"), f[3].alias("years"),
        month.alias("month"), weekend.alias("is_weekend"),
    )


def _kept_sql(least: int, most: int) -> str:
    return f"""
act AS (SELECT DISTINCT "accountId", date FROM txn_short),
kept AS (
  SELECT "accountId", date FROM act
  QUALIFY count(*) OVER (PARTITION BY "accountId") >= {least}
      AND row_number() OVER (PARTITION BY "accountId" ORDER BY date DESC) <= {most})"""


KEPT_SQL = _kept_sql(MIN_DAYS, MAX_DAYS)


@query(
    "last_active_days",
    "accountId:s day:s",
    with_views(TXN_SHORT, _kept_sql(MANY_DAYS, FEW_DAYS)) + ' SELECT "accountId", date AS day FROM kept',
)
def last_active_days(spark, sf):
    return X.kept_days(V.txn_short(spark, sf), MANY_DAYS, FEW_DAYS)


def _f32(expr: str) -> str:
    return f"CAST({expr} AS FLOAT)"


def _top_sql(variant: str, most: int = MAX_TXNS) -> str:
    neg, order = ("<= 0", "ts, id") if variant == "arrival" else ("< 0", "abs(amount) DESC, id")
    return f"""
top AS (
  SELECT *, row_number() OVER (PARTITION BY "accountId", date, stream ORDER BY {order}) AS rn
  FROM (SELECT *, CASE WHEN amount > 0 THEN 'pos' WHEN amount {neg} THEN 'neg' END AS stream FROM txn_short)
  WHERE stream IS NOT NULL QUALIFY rn <= {most}),
std AS (
  SELECT *, sign(amount) * (ln(1 + abs(amount)) - avg(ln(1 + abs(amount))) OVER s)
            / (stddev_pop(ln(1 + abs(amount))) OVER s + 1e-9) AS amount_std,
         ln(1 + sum(abs(amount)) OVER s) AS log_total_volume, count(*) OVER s AS n_txns
  FROM top WINDOW s AS (PARTITION BY "accountId", date, stream))"""


for _variant in ("arrival", "magnitude"):

    @query(
        f"top_of_stream_{_variant}",
        "id:s stream:s rn:i amount:f2",
        with_views(TXN_SHORT, _top_sql(_variant, FEW_TXNS)) + " SELECT id, stream, rn, amount FROM top",
    )
    def top_of_stream(spark, sf, _v=_variant):
        return X.top_of_stream(V.txn_short(spark, sf), FEW_TXNS, _v)


@query(
    "standardized_amounts",
    "id:s amount_std:f4",
    with_views(TXN_SHORT, _top_sql("magnitude"))
    + " SELECT id, amount_std FROM std",
)
def standardized_amounts(spark, sf):
    return X.standardize_amounts(X.top_of_stream(V.txn_short(spark, sf), 20, "magnitude"))


@query(
    "stream_volume",
    "account_id:s date:s stream:s log_total_volume:f4 n_txns:i",
    with_views(TXN_SHORT, _top_sql("arrival", FEW_TXNS))
    + f""" SELECT DISTINCT "accountId" AS account_id, date, stream, {_f32('log_total_volume')} AS log_total_volume, n_txns FROM std""",
)
def stream_volume(spark, sf):
    """Volumes as the examples carry them."""
    rows = X.explode_examples(X.build_examples(V.txn_short(spark, sf), max_days=10_000, max_txns=FEW_TXNS, min_days=1))
    day = F.date_add(F.lit("2020-01-01").cast("date"), "day_offset").alias("date")
    return rows.select("account_id", day, "stream", "log_total_volume", "n_txns").distinct()


def _log_sql(c: str) -> str:
    return f'coalesce(CASE WHEN r."{c}" < 0 THEN -ln(1 + abs(r."{c}")) ELSE ln(1 + abs(r."{c}")) END, 0)'


BALANCES = ("start", "end", "min", "max", "avg", "std", "starting")


def _examples_sql(variant: str) -> str:
    bal = (lambda c: _log_sql(c)) if variant == "arrival" else (lambda c: f'coalesce(r."{c}", 0)')
    return (
        with_views(LEDGER_SHORT, VOCAB_SQL, KEPT_SQL, _top_sql(variant))
        + f""" SELECT s."accountId" AS account_id, date_diff('day', DATE '2020-01-01', s.date) AS day_offset,
             month(s.date) AS month, CASE WHEN isodow(s.date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
             s.stream, s.rn, s.n_txns, g.token_id AS cat_group, u.token_id AS cat_sub, c.token_id AS cat_cp,
             {_f32('s.amount_std')} AS amount_std, {_f32('s.log_total_volume')} AS log_total_volume,
             isodow(s.date) - 1 AS dow, day(s.date) - 1 AS dom, month(s.date) - 1 AS mon,
             CAST(date_diff('day', DATE '2020-01-01', s.date) / CAST(365 AS DOUBLE) AS FLOAT) AS years,
             {", ".join(f"{_f32(bal(c))} AS bal_{c}" for c in BALANCES)}
           FROM std s JOIN kept k ON s."accountId" = k."accountId" AND s.date = k.date
           JOIN rolled_short r ON s."accountId" = r."accountId" AND s.date = r.date
           JOIN vocab g ON g.feature = 'cat_group' AND g.token = s."categoryGroupId"
           JOIN vocab u ON u.feature = 'cat_sub' AND u.token = s."subCategoryId"
           JOIN vocab c ON c.feature = 'cat_cp' AND c.token = s.counter_party"""
    )


def _examples(spark, sf, variant="arrival"):
    ensure_checkpoint_dir(spark)
    return build_dataset(
        V.txn_short(spark, sf), V.acct_events(spark, sf), _vocab(spark, sf).checkpoint(), variant,
        MAX_DAYS, MAX_TXNS, MIN_DAYS,
    )[0]


EXAMPLE_SHAPE = (
    "account_id:s day_offset:i month:i is_weekend:i stream:s rn:i n_txns:i cat_group:i cat_sub:i cat_cp:i "
    "amount_std:f4 log_total_volume:f4 dow:i dom:i mon:i years:f5 " + " ".join(f"bal_{c}:f3" for c in BALANCES)
)


def _flat_examples(ex, *carried):
    rows = X.explode_examples(ex, carried)
    return rows.withColumns(
        {
            "amount_std": F.col("amounts"),
            **{name: F.col("dates")[i] for i, name in enumerate(("dow", "dom", "mon", "years"))},
            **{f"bal_{c}": F.col("balance")[i] for i, c in enumerate(BALANCES)},
        }
    )


for _variant in ("arrival", "magnitude"):

    @query(f"examples_{_variant}", EXAMPLE_SHAPE, _examples_sql(_variant))
    def examples(spark, sf, _v=_variant):
        return _flat_examples(_examples(spark, sf, _v))


@query("examples_stored", EXAMPLE_SHAPE, _examples_sql("arrival"))
def examples_stored(spark, sf):
    """Nested rows written with their metadata and read back."""
    path = scratch_path(spark, "examples")
    S.write_examples(spark, _examples(spark, sf), path, {"max_days": MAX_DAYS, "max_txns": MAX_TXNS})
    return _flat_examples(spark.read.parquet(path))


@query(
    "examples_by_flag",
    "flag:s " + EXAMPLE_SHAPE,
    f"""SELECT 'F' || (CAST(account_id AS BIGINT) % 3) AS flag, * FROM ({_examples_sql("arrival")})""",
)
def examples_by_flag(spark, sf):
    """One dataset per flag, resumed. A first run has one flag; a second one is stopped after it has written part of
    another; the third finds the first done, replaces what is half-written and builds the rest."""
    ensure_checkpoint_dir(spark)
    vocab = stored(_vocab(spark, sf), "vocab")
    flag = F.concat(F.lit("F"), (F.col("accountId").cast("long") % 3).cast("string"))
    txns = V.txn_short(spark, sf).withColumn("flag", flag)
    root, out = scratch_path(spark, "flagged"), scratch_path(spark, "flag-examples")
    accounts = stored(V.acct_events(spark, sf), "accounts")
    go = lambda: build_flag_examples(root, out, accounts, vocab, "arrival", MAX_DAYS, MAX_TXNS, MIN_DAYS)
    txns.filter("flag = 'F1'").write.mode("append").partitionBy("flag").parquet(root)
    go()
    txns.filter("flag != 'F1'").write.mode("append").partitionBy("flag").parquet(root)
    half = spark.read.parquet(out).withColumn("flag", F.lit("F2"))
    half.filter(F.crc32("account_id") % 2 == 0).write.mode("append").partitionBy("flag").parquet(out)
    go()
    return _flat_examples(spark.read.parquet(out), "flag")


@query(
    "example_shapes",
    "account_id:s n_days:i n_pos:i n_neg:i empty_pos:i empty_neg:i",
    with_views(TXN_SHORT, KEPT_SQL, _top_sql("arrival"))
    + """, d AS (
      SELECT k."accountId" AS account_id, k.date, count(*) FILTER (stream = 'pos') AS p, count(*) FILTER (stream = 'neg') AS q
      FROM kept k LEFT JOIN top t ON k."accountId" = t."accountId" AND k.date = t.date GROUP BY ALL)
      SELECT account_id, count(*) AS n_days, sum(p) AS n_pos, sum(q) AS n_neg,
             count(*) FILTER (p = 0) AS empty_pos, count(*) FILTER (q = 0) AS empty_neg FROM d GROUP BY account_id""",
)
def example_shapes(spark, sf):
    ex = _examples(spark, sf)
    total = lambda s: F.aggregate(
        "days", F.lit(0), lambda a, d: a + F.coalesce(d[s]["n_txns"], F.lit(0))
    )
    none = lambda s: F.size(F.filter("days", lambda d: d[s].isNull()))
    return ex.select(
        "account_id", "n_days", total("pos").alias("n_pos"), total("neg").alias("n_neg"),
        none("pos").alias("empty_pos"), none("neg").alias("empty_neg"),
    )


@query(
    "balance_features_joined",
    "account_id:s day_offset:i stream:s rn:i " + " ".join(f"bal_{c}:f3" for c in BALANCES),
    with_views(LEDGER_SHORT)
    + """, moved AS (
        SELECT CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'nobody' || (CAST(id AS BIGINT) % 50) ELSE "accountId" END AS account_id, date, ts, id,
               CASE WHEN amount > 0 THEN 'pos' ELSE 'neg' END AS stream FROM txn_short),
      placed AS (SELECT *, row_number() OVER (PARTITION BY account_id, date, stream ORDER BY ts, id) AS rn FROM moved)
      SELECT account_id, date_diff('day', DATE '2020-01-01', p.date) AS day_offset, stream, rn, """
    + ", ".join(f'{_f32(f"""coalesce(r."{c}", 0)""")} AS bal_{c}' for c in BALANCES)
    + ' FROM placed p LEFT JOIN rolled_short r ON r."accountId" = p.account_id AND r.date = p.date',
)
def balance_features_joined(spark, sf):
    """The examples' balance vectors; seven zeros where the account and day are not found."""
    daily = B.daily_balances(V.txn_short(spark, sf), V.acct_events(spark, sf))
    side = B.feature_vector(B.rolling_features(daily), log=False)
    n = F.col("id").cast("long")
    nobody = F.concat(F.lit("nobody"), (n % 50).cast("string"))
    t = V.txn_short(spark, sf).withColumn("accountId", F.when(n % 4 == 0, nobody).otherwise(F.col("accountId")))
    return _flat_examples(X.build_examples(t, balance=side, max_days=10_000, max_txns=10_000, min_days=1))


@query(
    "example_audit",
    "account_id:s day_offset:i stream:s field:s n_nan:i n_null:i",
    with_views(TXN_SHORT, KEPT_SQL, _top_sql("arrival"))
    + """ SELECT s."accountId" AS account_id, date_diff('day', DATE '2020-01-01', s.date) AS day_offset, stream,
             'amounts' AS field, count(*) FILTER (CAST(s."accountId" AS BIGINT) % 2 = 0) AS n_nan,
             count(*) FILTER (CAST(s."accountId" AS BIGINT) % 2 = 1) AS n_null
          FROM std s JOIN kept k ON s."accountId" = k."accountId" AND s.date = k.date
          WHERE CAST(s."accountId" AS BIGINT) % 10 IN (4, 7) AND stream = 'pos' GROUP BY ALL""",
)
def example_audit(spark, sf):
    """Bad values planted in the credit amounts of some accounts are found again."""
    n = F.col("account_id").cast("long")
    bad = F.when(n % 10 == 4, F.lit(float("nan")).cast("float"))
    spoil = lambda d: d.withField(
        "pos",
        F.when(
            d["pos"].isNotNull(),
            d["pos"].withField("amounts", F.transform(d["pos"]["amounts"], lambda _: bad)),
        ),
    )
    ex = _examples(spark, sf)
    spoiled = F.when((n % 10).isin(4, 7), F.transform("days", spoil)).otherwise(F.col("days"))
    return X.audit_examples(ex.withColumn("days", spoiled))


BATCH = 16


#: What a padded rectangle holds, and the columns of a plain row that it comes from.
CELLS = ("cat_group", "cat_sub", "cat_cp", "amount_std", "dow", "dom", "mon", "years", *[f"bal_{c}" for c in BALANCES])
DAY_CELLS = ("day_offset", "month", "is_weekend")


@query(
    "padded_batches",
    "account_id:s batch_id:i max_days:i stream:s max_tx:i rows_ok:i n_mask:i n_has_data:i n_days:i volume:f3 "
    + " ".join(f"w_{c}:{'i' if c.startswith('cat') else 'f1'}" for c in CELLS) + " " + " ".join(f"w_{c}:i" for c in DAY_CELLS),
    "WITH rows AS ("
    + _examples_sql("arrival")
    + f"""), days AS (SELECT "accountId" AS account_id, date_diff('day', DATE '2020-01-01', date) AS day_offset, month(date) AS month,
                     CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
                     row_number() OVER (PARTITION BY "accountId" ORDER BY date) - 1 AS place FROM ({with_views(TXN_SHORT, KEPT_SQL)} SELECT * FROM kept)),
      per AS (SELECT account_id, count(*) AS n_days, {", ".join(f"sum({c} * (place + 1)) AS w_{c}" for c in DAY_CELLS)} FROM days GROUP BY account_id),
      numbered AS (SELECT *, (row_number() OVER (ORDER BY md5(account_id || '|7'), account_id) - 1) // {BATCH} AS batch_id FROM per),
      tx AS (SELECT batch_id, stream, max(rn) AS widest FROM rows JOIN numbered USING (account_id) GROUP BY ALL),
      dims AS (SELECT b.*, max(n_days) OVER (PARTITION BY b.batch_id) AS max_days, s.stream, greatest(1, coalesce(widest, 1)) AS max_tx
               FROM numbered b CROSS JOIN (SELECT unnest(['pos', 'neg']) AS stream) s LEFT JOIN tx ON tx.batch_id = b.batch_id AND tx.stream = s.stream),
      cells AS (
        SELECT d.account_id, d.stream, count(r.rn) AS n_mask, count(DISTINCT r.day_offset) AS n_has_data,
               coalesce(sum(log_total_volume) FILTER (r.rn = 1), 0) AS volume,
               {", ".join(f"coalesce(sum(CAST({c} AS DOUBLE) * (place * max_tx + rn)), 0) AS w_{c}" for c in CELLS)}
        FROM dims d LEFT JOIN (SELECT rows.*, place FROM rows JOIN days USING (account_id, day_offset)) r
          ON r.account_id = d.account_id AND r.stream = d.stream GROUP BY ALL)
      SELECT d.account_id, batch_id, max_days, d.stream, max_tx, 1 AS rows_ok, n_days, {", ".join(f"d.w_{c}" for c in DAY_CELLS)},
             c.* EXCLUDE (account_id, stream)
      FROM dims d JOIN cells c ON c.account_id = d.account_id AND c.stream = d.stream""",
)
def padded_batches(spark, sf):
    """Both rectangles of every example, all values: sums weighted by the place in the rectangle, where padding must
    add nothing, and the sizes of all rows. Examples are written first, as ranks and maxima read them too."""
    p = X.pad_batches(A.assign_batches(stored(_examples(spark, sf), "examples"), BATCH, seed=7))
    depth, s = F.col("max_tx"), F.col("s")
    square = lambda c: F.forall(c, lambda r: F.size(r) == depth)
    names = ("cat_group", "cat_sub", "cat_cp", "amounts", "dates", "balance", "mask")
    ok = F.size("day_mask") == F.col("max_days")
    for c in names:
        ok = ok & (F.size(s[c]) == F.col("max_days")) & square(s[c])
    ok = ok & F.forall(F.flatten(s["balance"]), lambda v: F.size(v) == 7) & F.forall(F.flatten(s["dates"]), lambda v: F.size(v) == 4)
    count = lambda c: F.size(F.filter(c, lambda v: v))

    def weighted(values, pick=lambda v: v):
        products = F.transform(values, lambda v, i: pick(v).cast("double") * (i + 1))
        return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)

    cells = {c: weighted(F.flatten(s[c])) for c in ("cat_group", "cat_sub", "cat_cp")}
    cells["amount_std"] = weighted(F.flatten(s["amounts"]))
    for at, c in enumerate(("dow", "dom", "mon", "years")):
        cells[c] = weighted(F.flatten(s["dates"]), lambda v, at=at: v[at])
    for at, c in enumerate(BALANCES):
        cells[f"bal_{c}"] = weighted(F.flatten(s["balance"]), lambda v, at=at: v[at])
    days = {"day_offset": "day_dates", "month": "day_month", "is_weekend": "day_weekend"}
    side = lambda n: F.struct(F.lit(n).alias("stream"), F.col(f"max_tx_{n}").alias("max_tx"), F.col(n).alias("s"))
    both = p.select("account_id", "batch_id", "max_days", "day_mask", *days.values(), F.inline(F.array(side("pos"), side("neg"))))
    return both.select(
        "account_id", "batch_id", "max_days", "stream", "max_tx", ok.cast("int").alias("rows_ok"),
        F.aggregate(s["mask"], F.lit(0), lambda a, r: a + count(r)).alias("n_mask"),
        count(s["has_data"]).alias("n_has_data"),
        count(F.col("day_mask")).alias("n_days"),
        F.aggregate(s["log_total_volume"], F.lit(0.0), lambda a, v: a + v.cast("double")).alias("volume"),
        *[v.alias(f"w_{c}") for c, v in cells.items()],
        *[weighted(F.col(c)).alias(f"w_{n}") for n, c in days.items()],
    )


def _cal(spark, sf):
    """Examples reduced to their day numbers."""
    from ..operators.points import calendars

    return calendars(V.txn_short(spark, sf)).select(
        "account_id", F.transform("day_dates", lambda d: F.struct(d.alias("day_offset"))).alias("days")
    )


CAL_SQL = """
cal AS (
  SELECT DISTINCT "accountId" AS account_id, date_diff('day', DATE '2020-01-01', date) AS d FROM txn_short),
pos_in AS (
  SELECT account_id, d, row_number() OVER (PARTITION BY account_id ORDER BY d) - 1 AS i,
         count(*) OVER (PARTITION BY account_id) AS n FROM cal)"""


def _u(*parts: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296"


@query(
    "last_n_days",
    "account_id:s day_offset:i",
    with_views(TXN_SHORT, CAL_SQL) + " SELECT account_id, d AS day_offset FROM pos_in WHERE i >= n - 10",
)
def last_n_days(spark, sf):
    capped = A.cap_days(_cal(spark, sf), 10)
    return capped.select("account_id", F.inline("days"))


@query(
    "temporal_crop",
    "account_id:s day_offset:i",
    with_views(TXN_SHORT, CAL_SQL)
    + f""", c AS (
        SELECT *, least(greatest(5, CAST(floor(n * (0.6 + {_u('account_id', "'1'", "'size'")} * (0.9 - 0.6))) AS INTEGER)), 360) AS len
        FROM pos_in),
      s AS (SELECT *, CAST(floor({_u('account_id', "'1'", "'start'")} * (n - len + 1)) AS INTEGER) AS start FROM c)
      SELECT account_id, d AS day_offset FROM s WHERE i >= start AND i < start + len""".replace(
        "(0.9 - 0.6)", f"CAST({A.CROP_HIGH - A.CROP_LOW!r} AS DOUBLE)"
    ).replace("(0.6 +", "(CAST(0.6 AS DOUBLE) +"),
)
def temporal_crop(spark, sf):
    key = (F.col("account_id"), 1)
    days = A.temporal_crop(F.col("days"), uniform(*key, "size"), uniform(*key, "start"), 360)
    return _cal(spark, sf).select("account_id", F.inline(days))


@query(
    "random_day_drop",
    "account_id:s day_offset:i",
    with_views(TXN_SHORT, CAL_SQL)
    + f""", k AS (SELECT *, {_u('account_id', "'1'", "'day'", 'i')} > 0.2 AS stay FROM pos_in),
      r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY i DESC) AS back FROM k WHERE stay)
      SELECT account_id, d AS day_offset FROM r WHERE back <= 20""",
)
def random_day_drop(spark, sf):
    return _cal(spark, sf).select("account_id", F.inline(A.random_drop(F.col("days"), (F.col("account_id"), 1), 20)))


_VIEW_SQL = f""", v AS (SELECT p.*, w.view FROM pos_in p, (VALUES (1), (2)) w(view)),
  c AS (SELECT *, {_u('account_id', 'view', "'5'", "'kind'")} < 0.5 AS crop,
         least(greatest(5, CAST(floor(n * (CAST(0.6 AS DOUBLE) + {_u('account_id', 'view', "'5'", "'size'")} * CAST({A.CROP_HIGH - A.CROP_LOW!r} AS DOUBLE))) AS INTEGER)), 360) AS len,
         {_u('account_id', 'view', "'5'", "'day'", 'i')} > 0.2 AS stay FROM v),
  s AS (SELECT *, CAST(floor({_u('account_id', 'view', "'5'", "'start'")} * (n - len + 1)) AS INTEGER) AS start FROM c),
  views AS (SELECT account_id, view, d AS day_offset FROM s
            WHERE n < 5 OR CASE WHEN crop THEN i >= start AND i < start + len ELSE stay END)"""


@query(
    "augmented_two_views",
    "account_id:s view:i day_offset:i",
    with_views(TXN_SHORT, CAL_SQL) + _VIEW_SQL + " SELECT * FROM views",
)
def augmented_two_views(spark, sf):
    return A.two_views(_cal(spark, sf), seed=5).select("account_id", "view", F.inline("days"))


@query(
    "augmentation_choice",
    "account_id:s view:i cropped:i n_days:i",
    with_views(TXN_SHORT, CAL_SQL)
    + _VIEW_SQL
    + """ SELECT s.account_id, s.view, max(CASE WHEN crop AND n >= 5 THEN 1 ELSE 0 END) AS cropped,
             (SELECT count(*) FROM views w WHERE w.account_id = s.account_id AND w.view = s.view) AS n_days
          FROM s GROUP BY s.account_id, s.view""",
)
def augmentation_choice(spark, sf):
    views = A.two_views(_cal(spark, sf), seed=5)
    kind = uniform(F.col("account_id"), F.col("view"), 5, "kind") < 0.5
    n = _cal(spark, sf).select("account_id", F.size("days").alias("n"))
    return views.join(n, "account_id").select(
        "account_id", "view", ((F.col("n") >= 5) & kind).cast("int").alias("cropped"), "n_days"
    )


@query(
    "batch_assignment",
    "account_id:s batch_id:i",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS account_id,
               (row_number() OVER (ORDER BY md5(c_custkey || '|11')) - 1) // 64 AS batch_id FROM customer""",
)
def batch_assignment(spark, sf):
    ids = V.acct(spark, sf).select(F.col("accountId").alias("account_id"))
    return A.assign_batches(ids, 64, seed=11)
