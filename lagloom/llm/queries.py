"""One query per corpus operator over its whole table, with SQL where SQL can
express it. Queries are thin: they call the operator and derive digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lagloom.llm import bpe, language, quality
from lagloom.llm.lines import dedup_lines
from lagloom.llm.neighbours import near_duplicate_vectors
from lagloom.llm.packing import pack_documents
from lagloom.llm.pitman_yor import language_model_scores
from lagloom.llm.runs import find_runs, tiled
from lagloom.llm.secret_scan import BASE, find_secrets
from lagloom.llm.shards import shuffled_shards
from lagloom.llm.sketches import near_duplicates
from lagloom.llm.topk import top_k, valid, whole_numbers
from lagloom.llm.zones import cluster_vectors, usable, whole_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pair as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
    vec_id, score
  from pair
)
select query_id, rank, vec_id, score from ranked where rank <= 5
""")
def op1_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where(valid(F.col("embedding")))
    rows = rows.select("vec_id", whole_numbers(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


@query()
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.learn(docs)
    rows = docs.select("doc_id", "text", language.held_out(F.col("doc_id")).alias("held_out"))
    return language.predict(rows, model)


@query()
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = _vocabulary("word_bpe_49k.json")
    coded = bpe.encode_texts(table(spark, folder, "documents").select("doc_id", "text"), path)
    both = bpe.decode_ids(coded, path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        _sha(F.col("decoded")).alias("decoded_sha256"),
    )


@query()
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    grade = quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade")
    graded = table(spark, folder, "labels").select("doc_id", grade)
    return quality.rate(docs, quality.fit_grades(docs, graded))


@query()
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = shuffled_shards(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    packed = pack_documents(docs, _vocabulary("byte_bpe_50k.json"), keep_ids=False)
    return packed.select(
        F.col("doc").alias("doc_id"),
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query()
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    return found.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        _sha(joined(base)).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query(r"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where embedding is not null and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93
), reach as (
  select vec_id as node, vec_id as found from embeddings
  union select r.node, l.b from reach r join link l on r.found = l.a
)
select r.node as vec_id, coalesce(any_value(n.n), 0) as n_links, min(r.found) as component_id,
  r.node = min(r.found) as kept
from reach r left join (select a, count(*) as n from link group by a) n on n.a = r.node
group by r.node
""")
def op8_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, folder, "embeddings"))


@query(r"""
with parts as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), line as (
  select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from parts
), keyed as (
  select doc_id, pos, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from line
), held as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40
  group by key having count(distinct doc_id) >= 5
), marked as (
  select k.*, h.keeper is not null and h.keeper <> k.doc_id as dropped
  from keyed k left join held h on k.key = h.key
)
select doc_id, count(*) as n_lines, cast(count(*) filter (dropped) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
""")
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query(r"""
with recursive word as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') as w
  from documents
), shingle as (
  select distinct doc_id, unnest(case when len(w) = 0 then []
    when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from word
), size as (
  select doc_id, count(*) as n from shingle group by doc_id
), pair as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id group by all
), link as (
  select p.a, p.b from pair p join size x on x.doc_id = p.a join size y on y.doc_id = p.b
  where 100 * p.c >= 75 * (x.n + y.n - p.c)
), reach as (
  select doc_id as node, doc_id as found from documents
  union select r.node, l.b from reach r join link l on r.found = l.a
), least as (
  select node, min(found) as component_id from reach group by node
)
select l.node as doc_id, coalesce(s.n, 0) as n_shingles, l.component_id,
  l.node = l.component_id as kept
from least l left join size s on s.doc_id = l.node
""")
def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))

@query()
def op11_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    scored = language_model_scores(docs, unseen)
    return scored.select(
        F.col("doc").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


# Runs as stretches of equal words q apart, found by joining equal words.
_RUNS_SQL = r"""
with word as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    -- crc32 of the decimal id, a byte at a time.
    xor(4294967295::bigint, list_reduce(
      list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
        lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) as h
  from documents
), sized as (
  select doc_id, w, len(w) as n, h % 10 = 0 as tile, (h // 10) % len(w) as a,
    1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) as p
  from word
), planted as (
  select doc_id, n, case when tile and n > 0 then
    list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) else w end as w
  from sized
), place as (
  select doc_id, n, unnest(w) as x, generate_subscripts(w, 1) - 1 as i from planted
), same as (
  select l.doc_id, r.i - l.i as q, l.i
  from place l join place r on l.doc_id = r.doc_id and l.x = r.x and r.i > l.i and 4 * (r.i - l.i) <= l.n
), stretch as (
  select doc_id, q, min(i) as start, count(*) + q as length
  from (select *, i - row_number() over (partition by doc_id, q order by i) as island from same)
  group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)
), run as (
  select * from stretch s where not exists (
    select 1 from stretch t where t.doc_id = s.doc_id and t.q < s.q and t.start <= s.start
      and t.start + t.length >= s.start + s.length)
), listed as (
  select doc_id, count(*) as n_runs, string_agg(concat(start, ',', length, ',', q, chr(10)), '' order by start, q) as runs,
    min(row(-length, start, q)) as best
  from run group by doc_id
), kept as (
  select p.doc_id, string_agg(p.x, ' ' order by p.i) as words from place p where not exists (
    select 1 from run r where r.doc_id = p.doc_id and p.i >= r.start + r.q and p.i < r.start + r.length)
  group by p.doc_id
)
select d.doc_id, coalesce(l.n_runs, 0) as n_runs, l.best[2] as start, -l.best[1] as length, l.best[3] as period,
  (-1000 * l.best[1]) // l.best[3] as exponent_milli, sha256(coalesce(l.runs, '')) as runs_sha256,
  sha256(coalesce(k.words, '')) as collapsed_sha256
from documents d left join listed l on l.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""


def _stretch(r: Column) -> Column:
    return F.concat_ws(",", r["start"], r["length"], r["period"])


@query(_RUNS_SQL)
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = find_runs(docs.select("doc_id", tiled(F.col("text"), seed).alias("text")))
    # The longest, then the first, then the shortest period.
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"]))
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat(_stretch(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed"
    ).select(
        "doc_id",
        "n_runs",
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.expr("(1000 * best.length) div -best.col3").alias("exponent_milli"),
        _sha(F.col("listed")).alias("runs_sha256"),
        _sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def _rounds_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds in whole numbers, one pair of tables each."""
    parts = [
        f"""v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (
  select cast(row_number() over (order by sha256('1:' || vec_id)) - 1 as integer) as cluster, v as c
  from v order by sha256('1:' || vec_id) limit {k}
)"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as (
  select vec_id, any_value(v) as v, min(row(d, cluster)) as best from (
    select vec_id, v, cluster,
      cast(list_sum(list_transform(generate_series(1, 64), lambda j: (v[j] - c[j]) * (v[j] - c[j]))) as bigint) as d
    from v cross join c{i}
  ) group by vec_id
)""")
        if i < rounds:
            parts.append(f"""m{i} as (
  select cluster, list(x order by j) as c from (
    select best[2] as cluster, j, cast(floor(sum(v[j]) / count(*)) as bigint) as x
    from a{i}, (select unnest(generate_series(1, 64)) as j) group by all
  ) group by cluster
), c{i + 1} as (
  select cluster, coalesce(m.c, o.c) as c from c{i} o left join m{i} m using (cluster)
)""")
    return "with " + ", ".join(parts) + f"""
select a.vec_id, a.best[2] as cluster, a.best[1] as distance,
  cast(sum(a.best[1]) over (partition by a.best[2]) as bigint) as cluster_inertia,
  cast(sum(a.best[1]) over () as bigint) as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on a.best[2] = c.cluster
"""


@query(_rounds_sql(16, 3))
def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where(usable(F.col("embedding"), 64))
    vectors = rows.select(F.col("vec_id").alias("id"), whole_vectors(F.col("embedding"), 64).alias("vector"))
    out = cluster_vectors(vectors, k=16, rounds=3, dims=64, seed=1)
    joined = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return out.select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
        _sha(joined).alias("centroid_sha256"),
    )


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
