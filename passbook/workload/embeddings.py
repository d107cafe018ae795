"""Queries on embedding tables and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, l2_norm, l2_normalize
from ..operators import embed as M
from ..operators import evaluate as E
from ..operators import models as K
from ..plans import views as V
from ..session import stored
from .registry import query
from .sqlviews import SCORES, TXN_SHORT, with_views

BATCH, SEED = 64, 3


def _pairs(spark, sf):
    """Vector, its neighbour and the next neighbour; the first follow the last."""
    v = V.vecs(spark, sf)
    n = v.agg(F.max("vec_id") + 1).scalar()
    after = lambda k, name: v.select(F.pmod(F.col("vec_id") - k, n).alias("id"), F.col("embedding").alias(name))
    a = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
    return a.join(after(1, "b"), "id").join(after(2, "hard"), "id")


PAIRS_SQL = f"""
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
size AS (SELECT max(id) + 1 AS n FROM v),
p0 AS (SELECT x.id, x.e AS a, y.e AS b, z.e AS hard FROM v x JOIN v y ON y.id = (x.id + 1) % (SELECT n FROM size)
       JOIN v z ON z.id = (x.id + 2) % (SELECT n FROM size)),
p AS (SELECT *, (row_number() OVER (ORDER BY md5(id || '|{SEED}'), id) - 1) // {BATCH} AS batch_id FROM p0),
sims AS (
  SELECT x.batch_id, x.id AS i, y.id AS j, list_cosine_similarity(x.a, y.b) AS c FROM p x JOIN p y ON x.batch_id = y.batch_id)"""


@query(
    "vector_arithmetic",
    "id:i norm:f6 dot:f6 cosine:f6 unit0:f6",
    with_views(PAIRS_SQL)
    + """ SELECT id, sqrt(list_dot_product(a, a)) AS norm, list_dot_product(a, b) AS dot,
             list_cosine_similarity(a, b) AS cosine, a[1] / sqrt(list_dot_product(a, a)) AS unit0 FROM p0""",
)
def vector_arithmetic(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf).select(
        "id", l2_norm(a).alias("norm"), dot(a, b).alias("dot"), cosine(a, b).alias("cosine"),
        l2_normalize(a)[0].alias("unit0"),
    )


@query(
    "batch_similarities",
    "id:i batch_id:i own:f6 n:i best:f6 total:f5 first:i second:f6",
    with_views(PAIRS_SQL)
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(c, 9) DESC, j) AS place FROM sims)
      SELECT i AS id, batch_id, max(c) FILTER (i = j) AS own, count(*) AS n, max(c) AS best, sum(c) AS total,
             max(j) FILTER (place = 1) AS first, max(c) FILTER (place = 2) AS second FROM placed GROUP BY ALL""",
)
def batch_similarities(spark, sf):
    s = M.batch_similarities(_pairs(spark, sf), BATCH, SEED, top=3)
    return s.withColumns({"first": F.col("near")[0]["id"], "second": F.get("near", F.lit(1))["s"]})


def _nce_sql(source: str) -> str:
    return f"""rows_ AS (SELECT batch_id, i, ln(sum(exp(c / 0.07))) - max(c / 0.07) FILTER (i = j) AS l FROM {source} GROUP BY ALL),
      cols_ AS (SELECT batch_id, j, ln(sum(exp(c / 0.07))) - max(c / 0.07) FILTER (i = j) AS l FROM {source} GROUP BY ALL)
      SELECT r.batch_id, r.n, (r.l + c.l) / 2 AS loss
      FROM (SELECT batch_id, count(*) AS n, avg(l) AS l FROM rows_ GROUP BY batch_id) r
      JOIN (SELECT batch_id, avg(l) AS l FROM cols_ GROUP BY batch_id) c ON r.batch_id = c.batch_id"""


@query("info_nce", "batch_id:i n:i loss:f6", with_views(PAIRS_SQL, _nce_sql("sims")))
def info_nce(spark, sf):
    return M.info_nce(_pairs(spark, sf), BATCH, SEED)


@query(
    "info_nce_one_batch",
    "batch_id:i n:i loss:f6",
    with_views(
        PAIRS_SQL,
        "whole AS (SELECT 0 AS batch_id, x.id AS i, y.id AS j, list_cosine_similarity(x.a, y.b) AS c FROM p0 x, p0 y)",
        _nce_sql("whole"),
    ),
)
def info_nce_one_batch(spark, sf):
    """The whole table as one batch."""
    pairs = _pairs(spark, sf)
    return M.info_nce(pairs, pairs.count(), SEED)


@query(
    "info_nce_hard_negatives",
    "batch_id:i n:i loss:f6",
    with_views(PAIRS_SQL)
    + """, h AS (SELECT id, list_cosine_similarity(a, hard) / 0.07 AS z FROM p),
      rows_ AS (SELECT batch_id, i, ln(sum(exp(c / 0.07)) + exp(max(h.z))) - max(c / 0.07) FILTER (i = j) AS l
                FROM sims JOIN h ON h.id = i GROUP BY batch_id, i)
      SELECT batch_id, count(*) AS n, avg(l) AS loss FROM rows_ GROUP BY batch_id""",
)
def info_nce_hard_negatives(spark, sf):
    return M.info_nce_hard(_pairs(spark, sf), BATCH, SEED)


@query(
    "embeddings_with_types",
    "id:s type:s",
    """SELECT vec_id AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Checking' ELSE c_mktsegment END AS type
       FROM embeddings LEFT JOIN customer ON c_custkey = vec_id * 5""",
)
def embeddings_with_types(spark, sf):
    acc = V.acct(spark, sf).select((F.col("accountId").cast("long") / 5).alias("id"), "type")
    doubled = acc.unionAll(acc)
    emb = V.vecs(spark, sf).select(F.col("vec_id").cast("double").alias("id"), "embedding")
    typed = M.with_account_types(emb, doubled)
    return typed.withColumn("id", F.col("id").cast("long"))


@query(
    "main_type_rows",
    "id:i type:s",
    """WITH t AS (SELECT vec_id AS id, CASE WHEN label < 4 THEN ['Checking', 'Savings', 'Credit Card', 'Loan'][label + 1]
                                            WHEN label < 7 THEN 'Other' END AS type FROM embeddings),
       k AS (SELECT * FROM t WHERE type IN ('Checking', 'Savings', 'Credit Card', 'Loan'))
       SELECT * FROM k WHERE (SELECT count(*) FROM k) > 100""",
)
def main_type_rows(spark, sf):
    kinds = F.array(*[F.lit(t) for t in M.MAIN_TYPES])
    typed = V.vecs(spark, sf).select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") < 4, F.get(kinds, F.col("label"))).when(F.col("label") < 7, "Other").alias("type"),
    )
    return M.main_types(M.known_types(typed))


@query(
    "sampled_accounts",
    "id:s type:s",
    """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Checking' ELSE c_mktsegment END AS type
       FROM customer ORDER BY md5(c_custkey || '|42'), c_custkey LIMIT 100""",
)
def sampled_accounts(spark, sf):
    acc = V.acct(spark, sf).withColumnRenamed("accountId", "id")
    return M.sample_rows(acc, 100, 42)


def _event_vectors(spark, sf):
    t = V.txn_short(spark, sf)
    return t.select(
        F.col("accountId").alias("account_id"),
        F.datediff("date", F.lit("2020-01-01").cast("date")).alias("day_offset"),
        F.when(F.col("amount") > 0, "pos").otherwise("neg").alias("stream"),
        F.array("amount", F.col("counter_party").cast("double"), F.hour("ts").cast("double")).alias("vec"),
    )


POOL_SQL = """
e AS (
  SELECT "accountId" AS account_id, date_diff('day', DATE '2020-01-01', date) AS day_offset,
         CASE WHEN amount > 0 THEN 'pos' ELSE 'neg' END AS stream, amount AS x, CAST(counter_party AS DOUBLE) AS y,
         hour(ts) AS z FROM txn_short),
d AS (
  SELECT account_id, day_offset,
         coalesce(avg(x) FILTER (stream = 'pos'), 0) AS v0, coalesce(avg(y) FILTER (stream = 'pos'), 0) AS v1,
         coalesce(avg(z) FILTER (stream = 'pos'), 0) AS v2, coalesce(avg(x) FILTER (stream = 'neg'), 0) AS v3,
         coalesce(avg(y) FILTER (stream = 'neg'), 0) AS v4, coalesce(avg(z) FILTER (stream = 'neg'), 0) AS v5
  FROM e GROUP BY ALL)"""
_V6 = [f"v{i}" for i in range(6)]


@query(
    "pooled_days",
    "account_id:s day_offset:i " + " ".join(f"{v}:f9" for v in _V6),
    with_views(TXN_SHORT, POOL_SQL) + " SELECT * FROM d",
)
def pooled_days(spark, sf):
    days = M.pool_days(_event_vectors(spark, sf), "vec", 3)
    return days.select("account_id", "day_offset", *[F.col("day_vector")[i].alias(v) for i, v in enumerate(_V6)])


@query(
    "pooled_accounts",
    "account_id:s " + " ".join(f"{v}:f9" for v in _V6),
    with_views(TXN_SHORT, POOL_SQL)
    + " SELECT account_id, "
    + ", ".join(f"avg({v}) AS {v}" for v in _V6)
    + " FROM d GROUP BY account_id",
)
def pooled_accounts(spark, sf):
    acc = M.pool_accounts(M.pool_days(_event_vectors(spark, sf), "vec", 3))
    return acc.select("account_id", *[F.col("account_vector")[i].alias(v) for i, v in enumerate(_V6)])


@query(
    "cosine_silhouette",
    "vec_id:i label:i silhouette:f6",
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
       d AS (SELECT x.vec_id, x.label, y.label AS other, sum(1 - list_cosine_similarity(x.e, y.e)) AS s, count(*) AS n
             FROM v x JOIN v y ON x.vec_id <> y.vec_id GROUP BY ALL),
       ab AS (SELECT vec_id, label, max(s / n) FILTER (label = other) AS a, min(s / n) FILTER (label <> other) AS b
              FROM d GROUP BY vec_id, label)
       SELECT vec_id, label, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab""",
)
def cosine_silhouette(spark, sf):
    return M.cosine_silhouette(V.vecs(spark, sf), "embedding", "label", list(range(10)))


def _squared_sql(name: str, source: str) -> str:
    """The first axis of a symmetric matrix (one row, a list of lists ``m``): squared and scaled until one axis is left."""
    return f"""{name}_powers AS (
       SELECT 0 AS k, m FROM {source}
       UNION ALL
       SELECT k + 1, list_transform(m2, lambda row: list_transform(row, lambda x: x / list_sum(list_transform(range(1, len(m2) + 1), lambda i: m2[i][i]))))
       FROM (SELECT k, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) AS m2 FROM {name}_powers WHERE k < 24)),
     {name}_column AS (
       SELECT m[list_position(list_transform(range(1, len(m) + 1), lambda i: m[i][i]), list_max(list_transform(range(1, len(m) + 1), lambda i: m[i][i])))] AS c
       FROM {name}_powers WHERE k = 24),
     {name}_unit AS (SELECT list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM {name}_column),
     {name} AS (SELECT list_transform(u, lambda x: x * sign(u[list_position(list_transform(u, lambda y: abs(y)),
                  list_max(list_transform(u, lambda y: abs(y))))])) AS u FROM {name}_unit)"""


def _pca_sql(views: str, end: str) -> str:
    """Axes of the vectors ``v`` (vec_id, label, e) in centred rows ``c``, and what to select."""
    return (
        "WITH RECURSIVE "
        + views
        + """,
     flat AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v),
     means AS (SELECT d, avg(x) AS mean FROM flat GROUP BY d),
     centred AS (SELECT vec_id, d, x - mean AS x FROM flat JOIN means USING (d)),
     rows_ AS (SELECT vec_id, list(x ORDER BY d) AS c FROM centred GROUP BY vec_id),
     cov AS (SELECT a.d AS i, b.d AS j, sum(a.x * b.x) / (SELECT count(*) - 1 FROM v) AS x FROM centred a JOIN centred b USING (vec_id) GROUP BY ALL),
     cov_rows AS (SELECT i, list(x ORDER BY j) AS r FROM cov GROUP BY i),
     matrix AS (SELECT list(r ORDER BY i) AS m FROM cov_rows),"""
        + _squared_sql("one", "matrix")
        + """, left_over AS (
       SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j:
                m[i][j] - u[i] * u[j] * list_dot_product(u, list_transform(m, lambda r: list_dot_product(r, u))))) AS m
       FROM matrix, one),"""
        + _squared_sql("two", "left_over")
        + """, projected AS (SELECT v.vec_id, label, list_dot_product(c, one.u) AS pc1, list_dot_product(c, two.u) AS pc2
                             FROM v JOIN rows_ USING (vec_id), one, two) """
        + end
    )


PCA_SQL = _pca_sql("v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)", "SELECT * FROM projected")


@query("pca_projection", "vec_id:i label:i pc1:f6 pc2:f6", PCA_SQL)
def pca_projection(spark, sf):
    return M.pca(V.vecs(spark, sf), "embedding")


REPORT_TYPES, REPORT_MIN = ("Checking", "MACHINERY", "HOUSEHOLD"), 10


@query(
    "type_report",
    "id:i type:s n_type:i pc1:f6 pc2:f6 silhouette:f6",
    _pca_sql(
        """v AS (SELECT vec_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Checking' ELSE c_mktsegment END AS label, CAST(embedding AS DOUBLE[]) AS e
              FROM embeddings JOIN customer ON c_custkey = vec_id * 5),
       main AS (SELECT * FROM v WHERE label IN ('Checking', 'MACHINERY', 'HOUSEHOLD')),
       d AS (SELECT x.vec_id, x.label, y.label AS other, sum(1 - list_cosine_similarity(x.e, y.e)) AS s, count(*) AS n
             FROM main x JOIN main y ON x.vec_id <> y.vec_id WHERE (SELECT count(*) FROM main) > 10 GROUP BY ALL),
       ab AS (SELECT vec_id, label, max(s / n) FILTER (label = other) AS a, min(s / n) FILTER (label <> other) AS b FROM d GROUP BY vec_id, label),
       sil AS (SELECT vec_id, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)""",
        """SELECT vec_id AS id, label AS type, count(*) OVER (PARTITION BY label) AS n_type, pc1, pc2, silhouette
           FROM projected LEFT JOIN sil USING (vec_id)""",
    ),
)
def type_report(spark, sf):
    """Joined account types: projection of all, silhouette among three of them."""
    accounts = V.acct(spark, sf).select((F.col("accountId").cast("long") / 5).alias("id"), "type")
    vectors = V.vecs(spark, sf).select(F.col("vec_id").cast("double").alias("id"), "embedding")
    report = M.type_report(vectors, accounts, types=REPORT_TYPES, min_samples=REPORT_MIN)
    return report.withColumn("id", F.col("id").cast("long"))


def _labelled(spark, sf):
    """Labelled documents with a vector (zeros where there is none) and 13 features: six counts and seven others."""
    lab, doc = V.table(spark, sf, "labels"), V.table(spark, sf, "documents")
    text = F.col("text")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    six = [F.col("n_chars").cast("double"), count(r"\S+"), count(r"\n"), count(r"[0-9]"), count(r"[A-Z]"), count(r"[.,]")]
    tail = [F.col("vector")[i].cast("double") for i in range(7)]
    emb = V.vecs(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")
    width = emb.agg(F.max(F.size("embedding"))).scalar()
    zeros = F.array_repeat(F.lit(0.0), width).cast(emb.schema["embedding"].dataType)
    rows = lab.join(doc, "doc_id").join(emb, "doc_id", "left").withColumn("vector", F.coalesce("embedding", zeros))
    return rows.select(
        F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("int").alias("label"),
        F.col("vector").alias("embedding"), F.array(*six, *tail).alias("features"),
    )


@query(
    "concatenated_features",
    "id:s n:i first:f6 weighted:f3 n_tail:i tail_weighted:f4",
    """WITH width AS (SELECT max(len(embedding)) AS d FROM embeddings),
       docs AS (
         SELECT CAST(l.doc_id AS VARCHAR) AS id, coalesce(CAST(embedding AS DOUBLE[]), list_transform(range(d), lambda i: CAST(0 AS DOUBLE))) AS v,
                [CAST(n_chars AS DOUBLE), len(regexp_extract_all(text, '\\S+')), len(regexp_extract_all(text, '\\n')),
                 len(regexp_extract_all(text, '[0-9]')), len(regexp_extract_all(text, '[A-Z]')), len(regexp_extract_all(text, '[.,]'))] AS six
         FROM labels l JOIN documents USING (doc_id) LEFT JOIN embeddings ON vec_id = l.doc_id, width),
       both_ AS (SELECT id, list_concat(v, six, v[1:7]) AS h, v[1:7] AS t FROM docs)
       SELECT id, len(h) AS n, h[1] AS first, list_sum(list_transform(h, lambda x, i: x * i)) AS weighted, len(t) AS n_tail,
              list_sum(list_transform(t, lambda x, i: x * i)) AS tail_weighted FROM both_""",
)
def concatenated_features(spark, sf):
    """Vectors and features side by side, compared value by value through sums weighted by their places."""
    df = M.tail_features(M.concat_features(_labelled(spark, sf), "embedding", "features"), "features")
    weighted = lambda c: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return df.select(
        "id", F.size("hybrid").alias("n"), F.col("hybrid")[0].alias("first"), weighted("hybrid").alias("weighted"),
        F.size("tail").alias("n_tail"), weighted("tail").alias("tail_weighted"),
    )


def _train_test(spark, sf):
    rows = stored(_labelled(spark, sf), "labelled")
    split = E.train_test_split(rows.select("id"), [42], id_col="id").select("id", "split")
    both = rows.join(split, "id")
    return both.filter("split = 'train'").drop("split"), both.filter("split = 'test'").drop("split")


@query("boosted_trees_scores", "method:s id:s label:i score:f6")
def boosted_trees_scores(spark, sf):
    train, test = _train_test(spark, sf)
    return K.score_methods(train, test, 42, ["GBT_Emb", "GBT_Feat", "GBT_Hybrid", "GBT_Bal"])


LOGISTIC_SQL = """WITH RECURSIVE width AS (SELECT max(len(embedding)) AS d FROM embeddings),
  docs AS (
    SELECT CAST(l.doc_id AS VARCHAR) AS id, quality AS label,
           list_append(coalesce(CAST(embedding AS DOUBLE[]), list_transform(range(d), lambda i: CAST(0 AS DOUBLE))), CAST(1 AS DOUBLE)) AS v
    FROM labels l JOIN documents USING (doc_id) LEFT JOIN embeddings ON vec_id = l.doc_id, width),
  placed AS (SELECT *, row_number() OVER (ORDER BY md5(id || '|42'), id) AS r, count(*) OVER () AS n FROM docs),
  parts AS (SELECT *, r <= n - ceil(n * CAST(0.3 AS DOUBLE)) AS train FROM placed),
  sizes AS (SELECT sum(label) AS p, sum(1 - label) AS q FROM parts WHERE train),
  fit AS (SELECT label, v, CASE label WHEN 1 THEN (p + q) / CAST(2 * p AS DOUBLE) ELSE (p + q) / CAST(2 * q AS DOUBLE) END AS w FROM parts, sizes WHERE train),
  steps AS (
    SELECT 0 AS k, list_transform(range(d + 1), lambda i: CAST(0 AS DOUBLE)) AS beta,
           list_transform(range(d + 1), lambda i: CAST(0 AS DOUBLE)) AS was, list_transform(range(d + 1), lambda i: CAST(0 AS DOUBLE)) AS gwas FROM width
    UNION ALL
    SELECT k + 1,
           list_transform(list_zip(beta, g), lambda x: x[1] - rate * x[2]), beta, g
    FROM (
      SELECT k, beta, g, CASE WHEN k = 0 THEN 1e-3
                            ELSE coalesce(list_dot_product(s, s) / nullif(list_dot_product(s, y), 0), 0) END AS rate
      FROM (
        SELECT k, beta, g, list_transform(list_zip(beta, was), lambda x: x[1] - x[2]) AS s, list_transform(list_zip(g, gwas), lambda x: x[1] - x[2]) AS y
        FROM (
          SELECT k, any_value(beta) AS beta, any_value(was) AS was, any_value(gwas) AS gwas, list(slope ORDER BY i) AS g
          FROM (
            SELECT k, i, any_value(beta) AS beta, any_value(was) AS was, any_value(gwas) AS gwas,
                   sum(w * (1 / (1 + exp(-z)) - label) * v[i]) + CASE WHEN i <= (SELECT d FROM width) THEN any_value(beta)[i] ELSE 0 END AS slope
            FROM (SELECT *, list_dot_product(beta, v) AS z FROM steps, fit WHERE k < 200), (SELECT unnest(range(1, d + 2)) AS i FROM width)
            GROUP BY k, i)
          GROUP BY k))))
  SELECT 'Linear_Emb' AS method, id, label, 1 / (1 + exp(-list_dot_product(beta, v))) AS score
  FROM parts, steps WHERE NOT train AND k = 200"""


@query("balanced_logistic_scores", "method:s id:s label:i score:f6", LOGISTIC_SQL)
def balanced_logistic_scores(spark, sf):
    train, test = _train_test(spark, sf)
    return K.score_methods(train, test, 42, ["Linear_Emb"])


ISSUES_SQL = """
limits AS (SELECT grp, avg(score) FILTER (label = 1) AS pos, avg(1 - score) FILTER (label = 0) AS neg FROM scores GROUP BY grp),
likely AS (
  SELECT s.*, CASE WHEN score >= pos AND 1 - score >= neg THEN CAST(score > 0.5 AS INTEGER)
                   WHEN score >= pos THEN 1 WHEN 1 - score >= neg THEN 0 END AS guess,
         CASE label WHEN 1 THEN 1 - 2 * score ELSE 2 * score - 1 END AS margin
  FROM scores s JOIN limits USING (grp)),
joint AS (
  SELECT grp, label, count(*) AS n, greatest(count(*) FILTER (guess = label), 1) AS kept, count(*) FILTER (guess = 1 - label) AS moved
  FROM likely GROUP BY ALL),
noise AS (SELECT *, least(CAST(round_even(n * moved / CAST(kept + moved AS DOUBLE), 0) AS BIGINT), n - 1) AS prune FROM joint)"""


@query(
    "noise_counts",
    "grp:s label:i n:i kept:i moved:i prune:i",
    with_views(SCORES, ISSUES_SQL) + " SELECT * FROM noise",
)
def noise_counts(spark, sf):
    return K.noise_counts(V.scores(spark, sf), ["grp"])


@query(
    "label_issues",
    "grp:s id:s label:i score:f6 issue:i",
    with_views(SCORES, ISSUES_SQL)
    + """ SELECT l.grp, id, l.label, score, CAST(prune > 0 AND CAST(score > 0.5 AS INTEGER) <> l.label
             AND (SELECT count(*) FROM likely x WHERE x.grp = l.grp AND x.label = l.label AND x.margin > l.margin) < prune AS INTEGER) AS issue
           FROM likely l JOIN noise n ON n.grp = l.grp AND n.label = l.label""",
)
def label_issues(spark, sf):
    """Rows pruned by noise rate among scores that every engine has alike."""
    return K.label_issues(V.scores(spark, sf), ["grp"]).withColumn("issue", F.col("issue").cast("int"))


@query("label_issues_out_of_fold", "id:s label:i score:f6 issue:i")
def label_issues_out_of_fold(spark, sf):
    rows = K.feature_sets(_labelled(spark, sf))
    return K.label_issues(K.out_of_fold(rows, "feat", 42)).withColumn("issue", F.col("issue").cast("int"))


@query("cleaned_label_scores", "method:s id:s label:i score:f6")
def cleaned_label_scores(spark, sf):
    train, test = _train_test(spark, sf)
    return K.score_methods(train, test, 42, ["PUL_Feat", "PUL_Emb"])


#: Methods that method_table fits side by side.
WORKERS = 4


@query("method_table", "method:s auc:f6 n_pos:i n_total:i lift_5:f6 lift_10:f6 conf_10:f6")
def method_table(spark, sf):
    train, test = _train_test(spark, sf)
    scored = stored(K.score_methods(train, test, 42, workers=WORKERS), "scored")
    return K.method_table(scored, ["method"])
