"""The queries of this subpackage and their SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, centroids, chat, divergence, fingerprint, licences, line_dedup, media, packing, quality, secrets, simhash
from tidewright.llm.jaccard_join import jaccard_components


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, threshold=(9, 10))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op3_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of documents that the licence classifier takes for a licence, with the templates' word on it."""
    return licences.licence_lines(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph sketches of every whole text and of its edited text, with their likeness."""
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored in an ISO media container, read back, with the container's features."""
    return media.text_round_trip(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by merge replay and decoded again."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every whole text, by a ledger of scanned blobs."""
    found = secrets.secret_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every whole text, by a factorisation machine that is fitted here."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines whose keys ten documents or more have."""
    found = line_dedup.drop_common_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source of a language, how far it is from the other sources, and the terms that set it apart."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents, and components of those at two differing bits or fewer."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds on the distinct ones."""
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_licence_scans": op3_licence_scans,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_media_columns": op6_media_columns,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_secret_scans": op8_secret_scans,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_source_divergence_audit": op11_source_divergence_audit,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_centroid_clustering": op13_centroid_clustering,
}

_LINES_OP10 = r"""
with docs as (select doc_id, coalesce(text, '') as body from documents),
lines as (
  select doc_id, place, split[place] as line
  from (select doc_id, string_split(body, chr(10)) as split, unnest(range(1, len(string_split(body, chr(10))) + 1)) as place from docs)
),
keyed as (
  select doc_id, place, line,
    translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
),
common as (select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select keyed.doc_id, count(*) as n_lines, count(common.k) as n_dropped,
  sha256(coalesce(string_agg(case when common.k is null then line end, chr(10) order by place), '')) as kept_sha256
from keyed left join common on keyed.k = common.k
group by keyed.doc_id
"""

_LINKS_OP1 = r"""
with recursive bodies as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents),
words as (select doc_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as w from bodies),
shingles as (
  select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end as s
  from (select *, unnest(range(1, greatest(len(w) - 1, 2))) as i from words where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as both_have from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * both_have >= 90 * (a.n + b.n - both_have)),
edges as (select x, y from links union all select y, x from links),
reach(doc_id, root) as (select doc_id, doc_id from documents union select e.y, r.root from reach r join edges e on e.x = r.doc_id),
degrees as (select x as doc_id, count(*) as d from edges group by x)
select reach.doc_id, coalesce(max(sizes.n), 0) as n_shingles, min(reach.root) as component_id, coalesce(max(degrees.d), 0) as n_links
from reach left join sizes using (doc_id) left join degrees using (doc_id) group by reach.doc_id
"""

_CHATS_OP2 = r"""
with turns as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as body from conversations where conv_id is not null
),
placed as (
  select conv_id, role, body, row_number() over (partition by conv_id order by turn, role, body) as place, count(*) over (partition by conv_id) as turns
  from turns
),
so_far as (
  select conv_id, place, turns,
    string_agg(chr(1) || role || chr(2) || body, '') over (partition by conv_id order by place rows between unbounded preceding and current row) as prefix
  from placed
),
whole as (select prefix, min(conv_id) as conv_id from so_far where place = turns group by prefix),
kept as (select conv_id from whole where prefix not in (select prefix from so_far where place < turns))
select conv_id, count(*) as n_turns,
  string_agg('<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(body, '<|', '< |') || chr(10) || '<|end|>' || chr(10), '' order by place) as rendered
from placed where conv_id in (select conv_id from kept) group by conv_id
"""

def _spans_sql(rank: int, kind: str, pattern: str, least: int, group: int = 0) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  select id, doc_id, {rank} as rank, '{kind}' as kind, {least} as least, regexp_extract_all(body, '{pattern}', 0) as hits,
    regexp_extract_all(body, '{pattern}', {group}) as worth, regexp_split_to_array(body, '{pattern}') as gaps from docs"""


# the patterns as they are stated, without what the rules add for speed; short matches are dropped by their lengths
_SECRETS_OP8 = f"""
with docs as (select row_number() over () as id, doc_id, coalesce(text, '') as body from documents),
hits as ({" union all ".join((
    _spans_sql(0, "assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    _spans_sql(1, "access", r"AKIA[A-Z0-9]+", 20),
    _spans_sql(2, "hex", r"[0-9a-f]+", 24),
    _spans_sql(3, "pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1),
    _spans_sql(4, "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1),
))}),
placed as (
  select id, rank, kind, least, n, length(gaps[n]) as gap, length(hits[n]) as hit, length(worth[n]) as value
  from (select *, unnest(range(1, len(hits) + 1)) as n from hits)
),
ends as (select *, cast(sum(gap + hit) over (partition by id, rank order by n) as bigint) as stop from placed),
kept as (select id, rank, kind, stop - hit as start, kind || ':' || (stop - hit) || ':' || stop as span from ends where value >= least)
select docs.doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
  sha256(coalesce(string_agg(span, ',' order by start, rank) filter (rank < 3), '')) as base_sha256, coalesce(string_agg(span, ',' order by start, rank), '') as spans
from docs left join kept using (id) group by docs.id, docs.doc_id
"""

_TERMS_OP11 = r"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body
  from documents
),
occurs as (
  select id, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
),
kept as (select lang, term from occurs group by lang, term having count(distinct id) >= 10),
counts as (select lang, source, term, count(*) as n from occurs join kept using (lang, term) group by lang, source, term),
sources as (select distinct lang, source from docs),
cells as (
  select lang, source, term, coalesce(n, 0) as n from sources join kept using (lang) left join counts using (lang, source, term)
),
shares as (
  select lang, source, term, n,
    1 + (1000000000 * (n::hugeint + 2)) // (sum(n) over (partition by lang, source) + 2 * count(*) over (partition by lang, source)) as p
  from cells
),
of_lang as (select lang, term, sum(n) as n from cells group by lang, term),
lang_shares as (
  select lang, term, 1 + (1000000000 * (n::hugeint + 2)) // (sum(n) over (partition by lang) + 2 * count(*) over (partition by lang)) as q from of_lang
),
apart as (
  select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as f
  from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
),
pairs as (
  select x.lang, x.source, 'pair' as part, y.source as item, cast(coalesce(f, 0) as bigint) as value
  from sources x join sources y on x.lang = y.lang and x.source <> y.source
  left join apart on apart.lang = x.lang and apart.source = x.source and apart.item = y.source
),
terms as (
  select lang, source, 'term' as part, term as item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value
  from shares join lang_shares using (lang, term) where n > 0 and p > q
),
ranked as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
  from (select * from pairs union all select * from terms)
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""


def _rounds_sql(rounds: int) -> str:
    """Lloyd's rounds one after another: places in ``g<n>``, clusters in ``a<n>``, the next centroids in ``g<n + 1>``."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
d{n} as materialized (select v.id, g.c, cast(sum((v.x - g.y) * (v.x - g.y)) as bigint) as d from parts v join g{n} g using (place) group by v.id, g.c),
a{n} as materialized (select id, arg_min(c, (d, c)) as c, min(d) as d from d{n} group by id),
s{n} as (select a.c, v.place, sum(v.x) as s, count(*) as n from parts v join a{n} a using (id) group by a.c, v.place),
g{n + 1} as materialized (
  select g.c, g.place, cast(case when s.n is null then g.y else (s.s - ((s.s % s.n) + s.n) % s.n) // s.n end as bigint) as y
  from g{n} g left join s{n} s using (c, place)
)""")
    return ",".join(steps)


_CLUSTERS_OP13 = f"""
with kept as materialized (
  select row_number() over () as id, vec_id, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
),
parts as materialized (
  select id, vec_id, place, cast(floor(1024 * cast(embedding[place] as double)) as bigint) as x from (select *, unnest(range(1, 65)) as place from kept)
),
firsts as (select id, row_number() over (order by sha256('3:' || cast(vec_id as varchar))) - 1 as c from kept qualify c < 8),
g0 as materialized (select c, place, x as y from parts join firsts using (id)),
{_rounds_sql(10)},
names as (select c, sha256(string_agg(cast(y as varchar), ',' order by place)) as centroid_sha256 from g10 group by c),
sums as (select c, sum(d) as cluster_inertia from a10 group by c)
select vec_id, cast(a10.c as integer) as cluster, d as distance, cast(cluster_inertia as bigint) as cluster_inertia,
  cast((select sum(d) from a10) as bigint) as inertia, centroid_sha256
from a10 join kept using (id) join names on names.c = a10.c join sums on sums.c = a10.c
"""

SQL: dict[str, str] = {"op1_ngram_jaccard_join": _LINKS_OP1, "op8_secret_scans": _SECRETS_OP8, "op2_chat_formatting": _CHATS_OP2, "op10_line_dedup": _LINES_OP10, "op11_source_divergence_audit": _TERMS_OP11, "op13_centroid_clustering": _CLUSTERS_OP13}
