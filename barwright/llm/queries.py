"""The registered queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barwright.llm import bpe, capfilter, chat, fm, nbsvm, packing, pieces, shallot, shardtree, simhash, slices, topk, warc
from barwright.llm.shared import table


def op1_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of held-out documents are never seen (nbsvm.classify says what odd rows give)."""
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (simhash.near_duplicates says what odd rows give)."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every vector whose id is divisible by 50 (topk.top_k says what odd rows give)."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op4_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one that holds control strings, read back from its formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.format_conversations(rows.unionByName(probe))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back (warc.archive_and_read says what odd rows give)."""
    return warc.archive_and_read(table(spark, sf_dir, "pages"), min_bytes=0)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of every document's pieces in sequences of 2048 tokens (packing.pack says what odd rows give)."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's whole text and the text decoded from them, as digests (see bpe.digests)."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of held-out documents are never seen (fm.classify says what odd rows give)."""
    return fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.5)


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector (capfilter.near_duplicates says what odd rows give)."""
    return capfilter.near_duplicates(table(spark, sf_dir, "embeddings"), least_cos=0.98)


def op10_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, and its shard if there were nine (see shardtree.assign)."""
    return shardtree.assign(table(spark, sf_dir, "documents"), shards=8)


def op11_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 components (shallot.cluster says what odd rows give)."""
    return shallot.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, dim=64, salt="1:")


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, spans and decoded text of every document's whole text, as digests (pieces.encode says what odd rows give)."""
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_slice_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every vector (slices.compress says what odd rows give)."""
    return slices.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


QUERIES = {
    "op1_nbsvm_quality": op1_nbsvm_quality,
    "op2_simhash": op2_simhash,
    "op3_cover_tree_topk": op3_cover_tree_topk,
    "op4_chat_trees": op4_chat_trees,
    "op5_warc": op5_warc,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_fm_toxicity": op8_fm_toxicity,
    "op9_cap_filters": op9_cap_filters,
    "op10_hash_tree_shards": op10_hash_tree_shards,
    "op11_shallot_clusters": op11_shallot_clusters,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_slice_codes": op13_slice_codes,
}

_WHOLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _floor_mean(total: str, count: str) -> str:
    return f"cast(({total} - (({total} % {count}) + {count}) % {count}) // {count} as bigint)"


def _clusters_sql(k: int, rounds: int) -> str:
    """Each round is a pair of tables: nearest centroid (distance and number in one integer), and new centroids."""
    sql = f"""with v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) as x from embeddings where len(embedding) = 64 and {_WHOLE}),
    e as materialized (select vec_id, unnest(range(1, 65)) as i, unnest(x) as x from v),
    s as (select vec_id, row_number() over (order by sha256('1:' || vec_id)) - 1 as c from v),
    c0 as materialized (select c, i, x as y from s join e using (vec_id) where c < {k})"""
    for r in range(rounds + 1):
        sql += f""",
    a{r} as materialized (select vec_id, min(d * {k} + c) as m from (select vec_id, c, cast(sum((x - y) * (x - y)) as bigint) as d from e join c{r} using (i) group by vec_id, c) group by vec_id)"""
        if r < rounds:
            sql += f""",
    n{r} as (select m % {k} as c, i, cast(sum(x) as bigint) as s, count(*) as n from a{r} join e using (vec_id) group by m % {k}, i),
    c{r + 1} as materialized (select c, i, coalesce({_floor_mean("s", "n")}, y) as y from c{r} left join n{r} using (c, i))"""
    return sql + f""",
    h as (select c, sha256(string_agg(cast(y as varchar), ',' order by i)) as h from c{rounds} group by c)
    select vec_id, cast(c as integer) as cluster, m // {k} as distance, cast(sum(m // {k}) over (partition by c) as bigint) as cluster_inertia, cast(sum(m // {k}) over () as bigint) as inertia, h as centroid_sha256
    from a{rounds} join h on c = m % {k}"""


def _codes_sql(rounds: int) -> str:
    sql = f"""with v as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * x::double) as bigint)) as x from embeddings where {_WHOLE}),
    e as materialized (select vec_id, (i - 1) // (n // 8) as p, i, x from (select vec_id, len(x) as n, unnest(range(1, len(x) + 1)) as i, unnest(x) as x from v)),
    s as (select vec_id, row_number() over (order by vec_id) - 1 as c from v),
    c0 as materialized (select c, p, i, x as y from s join e using (vec_id) where c < 16)"""
    for r in range(rounds + 1):
        sql += f""",
    a{r} as materialized (select vec_id, p, min(d * 16 + c) as m from (select vec_id, e.p, c, cast(sum((x - y) * (x - y)) as bigint) as d from e join c{r} using (i) group by vec_id, e.p, c) group by vec_id, p)"""
        if r < rounds:
            sql += f""",
    n{r} as (select m % 16 as c, i, cast(sum(x) as bigint) as s, count(*) as n from a{r} join e using (vec_id, p) group by m % 16, i),
    c{r + 1} as materialized (select c, p, i, coalesce({_floor_mean("s", "n")}, y) as y from c{r} left join n{r} using (c, i))"""
    return sql + f""",
    f as (select vec_id, string_agg(lower(printf('%02x', m % 16)), '' order by p) as code, cast(sum(m // 16) as bigint) as error from a{rounds} group by vec_id),
    h as (select sha256(string_agg(cast(y as varchar), ',' order by p, c, i)) as codebooks_sha256 from c{rounds})
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from f join v using (vec_id), h"""


ORACLES: dict[str, str] = {
    "op11_shallot_clusters": _clusters_sql(16, 3),
    "op13_slice_codes": _codes_sql(6),
    "op3_cover_tree_topk": f"""with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings where vec_id is not null and {_WHOLE}),
    s as (select q.vec_id as query_id, v.vec_id, cast(list_dot_product(q.x, v.x) as bigint) as score from v q join v on v.vec_id <> q.vec_id where q.vec_id % 50 = 0)
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s qualify rank <= 5""",
    # a digest's 160 bits are eight times 20 bits, each four letters
    "op5_warc": """with p as (select page_id, coalesce(html, '') as body from pages), d as (select *, sha1(body) as h, max(page_id) over (partition by body) as first from p)
    select page_id, octet_length(encode(body)) as payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, cast(1 + 5 * (i // 4) as integer), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as integer), 1)), 'string_agg', '') as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from d""",
    "op9_cap_filters": f"""with recursive v as (select vec_id, label, embedding::double[] as x from embeddings where label is not null and {_WHOLE} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    e as (select a.vec_id as u, b.vec_id as w from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.98),
    r(node, root) as (select vec_id, vec_id from embeddings union select e.w, r.root from r join e on e.u = r.node), c as (select node, min(root) as component_id from r group by node), n as (select u, count(*) as n from e group by u)
    select vec_id, coalesce(n, 0) as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept from embeddings left join c on c.node = vec_id left join n on u = vec_id""",
}
