"""Registered queries of the retrieval and curation operators, with DuckDB SQL for each that SQL can express.

Queries run over whole tables. A query set is a stated part of a table (vectors or items whose
number is divisible by 20) that is matched against all rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions import vectors as V
from foliant.operators import chunking, clusters, curation, fulltext, models, retrieval, sessions, similarity
from foliant.sources import catalog, memory
from foliant.sources.corpus import CHUNK_SCHEMA, knowledge, table, vectors
from foliant.sources.scratch import fresh_path, written
from foliant.sources.store import ChunkStore, near_rows
from foliant.sources.textindex import TextIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Parameters of the registered queries.
NOW, WEIGHT, HALF_LIFE, QUERY_STEP = "2025-03-01 00:00:00", 0.3, 90.0, 20
#: When the stored chunk table of sync_index was written.
BEFORE = "2025-02-01 00:00:00"


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_ENDS = _sql_text(X.ENDS)


def _strip(column: str) -> str:
    return f"regexp_replace({column}, {_ENDS}, '', 'g')"


def _scrub(column: str) -> str:
    for pattern, replacement in X.SECRETS:
        column = f"regexp_replace({column}, {_sql_text(pattern)}, {_sql_text(replacement.replace('{1}', chr(92) + '1'))}, 'g')"
    return column


def _distinct(values: str) -> str:
    """Distinct members of a list in the order of their first use. values must name a column."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def _contains(column: str, keys: list[str]) -> str:
    return " or ".join(f"contains({column}, {_sql_text(k)})" for k in keys)




def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, {_sql_text(X.SPACE)}), lambda w: w <> '')"


def _terms(column: str) -> str:
    return f"regexp_extract_all(lower({column}), {_sql_text(X.TOKEN)})"


#: The default embedder: counts of words by the last six bits of their md5, at unit length.
def _places(text: str) -> str:
    """A list of places; it goes to a column ps, _COUNTS to a column c, and _UNIT is the vector."""
    digit = lambda k: f"(instr('0123456789abcdef', substr(md5(w), {k}, 1)) - 1)"
    return f"list_transform({_words(f'lower({text})')}, lambda w: ({digit(31)} & 3) * 16 + {digit(32)})"


_COUNTS = "list_transform(range(64), lambda i: len(list_filter(ps, lambda p: p = i)))"
_NORM = "sqrt(list_sum(list_transform(c, lambda x: (x * x)::double)))"
_UNIT = f"case when {_NORM} = 0 then list_transform(range(64), lambda i: case when i = 0 then 1.0::double else 0.0::double end) else list_transform(c, lambda x: (x / {_NORM})::float::double) end"

_HASH = f"sha256(array_to_string({_words('lower(text)')}, ' '))"
_PATH = (
    "case cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 7 when 0 then 'repos/' || source || '/research/sessions/' when 1 then 'vault/archive/' || source || '/' when 2 then 'vault/library/' || source || '/' "
    "when 3 then 'repos/' || source || '/research/' when 4 then 'repos/' || source || '/docs/' when 5 then 'vault/library/sessions/' || source || '/' else 'repos/' || source || '/notes/' end || 'doc' || doc_id || '.md'"
)
_TYPE = (
    "case when contains(doc_path, '/research/sessions/') or contains(doc_path, '/vault/library/sessions/') or starts_with(doc_path, 'vault/library/sessions/') then 'session' "
    "when contains(doc_path, '/vault/archive/') or starts_with(doc_path, 'vault/archive/') then 'archive' when contains(doc_path, '/vault/library/') or starts_with(doc_path, 'vault/library/') then 'library' "
    "when list_contains([" + ", ".join(map(_sql_text, X.CONTEXT_FILES)) + "], split_part(doc_path, '/', -1)) then 'project' when contains(doc_path, '/research/') then 'research' "
    "when contains(doc_path, '/docs/') or contains(doc_path, '/machines/') or contains(doc_path, '/playbooks/') then 'docs' else 'library' end"
)
_BOOST = "case source_type " + " ".join(f"when '{k}' then {v}::double" for k, v in X.BOOSTS.items()) + " else 1.0::double end"
_KNOWLEDGE = f"k0 as (select doc_id, text, {_PATH} as doc_path, timestamp '2024-01-01' + to_hours(doc_id % 10000) as authored_at from documents), knowledge as (select *, {_TYPE} as source_type from k0)"
_VECTORS = _KNOWLEDGE + ", vecs as (select e.vec_id, e.embedding::double[] as v, e.label, k.source_type, k.authored_at, k.doc_path, k.text from embeddings e join knowledge k on e.vec_id = k.doc_id)"
_SIMILAR = "pairs as (select q.vec_id as query_id, b.vec_id as id, round(list_dot_product(q.v, b.v), 9) as similarity, b.source_type, b.authored_at from vecs q join vecs b on q.vec_id <> b.vec_id where q.vec_id % 20 = 0)"


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def _vector_queries(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _base(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


# text functions


@query("content_hash", f"select doc_id, {_HASH} as content_hash from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("token_estimate", f"select doc_id, cast(floor(len({_words('text')}) * 1.3::double) as int) as tokens from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("document_keys", f"with {_KNOWLEDGE} select doc_path, substr(md5(doc_path), 1, 12) as doc_key, sha256(doc_path || '|0|' || {_HASH}) as chunk_id from knowledge")
def _(spark, sf):
    path = F.col("doc_path")
    return knowledge(spark, sf).select(path, X.document_key(path).alias("doc_key"), X.chunk_key(path, F.lit(0), X.content_hash(F.col("text"))).alias("chunk_id"))


_CLASS = "case " + " ".join(f"when {_contains('lower(text)', keys)} then '{name}'" for name, keys in X.QUERY_CLASSES.items()) + " else 'general' end"
_PROMPT = "case query_class " + " ".join(f"when '{k}' then {_sql_text(v)}" for k, v in X.QUERY_PROMPTS.items()) + f" else {_sql_text(X.DEFAULT_PROMPT)} end"


@query("query_class", f"with c as (select item_id, text, {_CLASS} as query_class from benchmark) select item_id, query_class, md5({_PROMPT} || text) as prompted from c")
def _(spark, sf):
    text = F.col("text")
    return table(spark, sf, "benchmark").select("item_id", X.query_class(text).alias("query_class"), F.md5(X.prompted(text)).alias("prompted"))


@query("source_type", f"with {_KNOWLEDGE} select doc_id, doc_path, source_type, {_BOOST} as boost from knowledge")
def _(spark, sf):
    return knowledge(spark, sf).select("doc_id", "doc_path", "source_type", X.boost(F.col("source_type")).alias("boost"))


_SCRUB = _scrub("text")


@query("scrubbed_text", f"select doc_id, md5({_SCRUB}) as scrubbed, {_SCRUB} <> text as changed from documents")
def _(spark, sf):
    clean = X.scrubbed(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(clean).alias("scrubbed"), (clean != F.col("text")).alias("changed"))


@query("slugs", "select doc_id, regexp_replace(substr(array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 8), '-'), 1, 48), '^-+|-+$', '', 'g') as slug, regexp_matches(source, '^[A-Za-z0-9][A-Za-z0-9._-]*$') as safe from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"), X.safe_name(F.col("source")).alias("safe"))


@query("frontmatter", r"""select conv_id, turn, '---' || chr(10) || 'type: note' || chr(10) || 'project: ' || role || chr(10) || 'title: ' || regexp_replace(regexp_replace(text, '""" + X.LINE + r"""', ' ', 'g'), '""" + X.ENDS + r"""', '', 'g') || chr(10) || '---' || chr(10) as head from conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.frontmatter(F.col("role"), project=F.col("role"), title=F.col("text")).alias("head"))


@query("pair_text", "select doc_id, md5(substr(case when source <> '' and source <> '(no heading)' then '## ' || source || chr(10) || text else text end, 1, 3000)) as pair, md5(substr(text, 1, 1000)) as asked from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.pair_text(F.col("source"), F.col("text"))).alias("pair"), F.md5(X.asked_text(F.col("text"))).alias("asked"))


@query("line_spans", "with s as (select doc_id, text, length(text) // 4 as a, length(text) // 2 as b from documents) select doc_id, cast(length(substr(text, 1, a)) - length(replace(substr(text, 1, a), chr(10), '')) + 1 as int) as line_start, cast(length(substr(text, 1, greatest(a, b - 1))) - length(replace(substr(text, 1, greatest(a, b - 1)), chr(10), '')) + 1 as int) as line_end from s")
def _(spark, sf):
    size = F.length("text")
    cut = table(spark, sf, "documents").select("doc_id", X.line_span(F.col("text"), F.floor(size / 4).cast("int"), F.floor(size / 2).cast("int")).alias("s"))
    return cut.select("doc_id", "s.line_start", "s.line_end")


_NOTE = "'# ' || source || chr(10) || chr(10) || '_Consolidated today_' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## ⚠ Contradictions reconciled (newer supersedes)' || chr(10) || '- **prior:** x' || chr(10) || chr(10) || '## Sources' || chr(10) || '- a.md' || chr(10)"


# the contradictions of these notes come last but for the sources, so both go together
@query("canonical_body", f"with n as (select doc_id, {_NOTE} as note from documents), b as (select doc_id, regexp_replace(regexp_replace(note, '(?s)\\n*## ⚠ Contradictions reconciled.*$', ''), '^\\s*#[^\\n]*\\n+_Consolidated[^\\n]*_\\s*', '') as body from n) select doc_id, {_strip('body')} as body from b")
def _(spark, sf):
    note = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n_Consolidated today_\n\n"), F.col("text"), F.lit(f"\n\n{X.CONTRADICTIONS}\n- **prior:** x\n\n## Sources\n- a.md\n"))
    return table(spark, sf, "documents").select("doc_id", X.canonical_body(note).alias("body"))


_UNITS = f"list_filter(list_transform(regexp_split_to_array(text, {_sql_text(X.LINE)}), lambda l: regexp_replace(regexp_replace(l, {_sql_text(X.LIST_MARKER)}, ''), {_ENDS}, '', 'g')), lambda u: length(u) >= 20 and not starts_with(u, '#'))"
_FACT = "units[1 + case when k <= 120 then i when i = 119 then k - 1 else cast(trunc(i * ((k - 1)::double / 119.0::double)) as bigint) end]"


@query("fact_units", f"with u as (select doc_id, {_UNITS} as units from documents), n as (select doc_id, units, len(units) as k, unnest(range(0, least(len(units), 120))) as i from u) select doc_id, cast(i as int) as n, md5({_FACT}) as fact from n")
def _(spark, sf):
    found = sessions.facts(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"), "n", F.md5("fact").alias("fact"))


# search


@query("vector_topk", f"with {_VECTORS}, {_SIMILAR} select query_id, id, round(2 - 2 * similarity, 6) as distance from pairs qualify row_number() over (partition by query_id order by similarity desc, id) <= 20")
def _(spark, sf):
    rows = vectors(spark, sf)
    return similarity.similar(_base(rows), _vector_queries(rows), k=20).select("query_id", "id", F.round(2 - 2 * F.col("similarity"), 6).alias("distance"))


@query("filtered_topk", f"with {_VECTORS}, {_SIMILAR} select query_id, id, round(2 - 2 * similarity, 6) as distance from pairs where source_type <> 'session' qualify row_number() over (partition by query_id order by similarity desc, id) <= 10")
def _(spark, sf):
    rows = vectors(spark, sf)
    kept = rows.where("source_type <> 'session'")
    return similarity.similar(_base(kept), _vector_queries(rows), k=10).select("query_id", "id", F.round(2 - 2 * F.col("similarity"), 6).alias("distance"))


_AGE = f"(epoch(timestamp '{NOW}') - epoch(authored_at)) / 86400.0::double"
_RECENT = f"(1.0::double - {WEIGHT}::double * pow(0.5::double, greatest({_AGE}, 0.0::double) / {HALF_LIFE}::double))"


@query("boosted_topk", f"with {_VECTORS}, {_SIMILAR}, near as (select *, 2 - 2 * similarity as d from pairs qualify row_number() over (partition by query_id order by similarity desc, id) <= 20), b as (select query_id, id, round(d * {_BOOST} * {_RECENT}, 9) as boosted from near) select query_id, id, round(boosted, 6) as boosted, row_number() over (partition by query_id order by boosted, id) as rank from b")
def _(spark, sf):
    rows = vectors(spark, sf)
    near = similarity.similar(_base(rows), _vector_queries(rows), k=20).join(rows.select(F.col("vec_id").alias("id"), "source_type", "authored_at"), "id")
    age = (F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.col("authored_at").cast("timestamp"))) / 86400.0
    boosted = F.round((2 - 2 * F.col("similarity")) * X.boost(F.col("source_type")) * X.recency(age, WEIGHT, HALF_LIFE), 9)
    marked = near.withColumn("b", boosted)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("b", "id"))
    return marked.select("query_id", "id", F.round("b", 6).alias("boosted"), place.alias("rank"))


_BM25 = (
    "asked as (select distinct item_id as query_id, unnest(" + _terms("text") + ") as term from benchmark where item_id % 20 = 0), "
    "listed as (select doc_id, " + _terms("text") + " as terms from documents), size as (select count(*)::double as n, avg(len(terms)) as mean from listed), "
    "tokens as (select doc_id, len(terms) as length, unnest(terms) as term from listed), "
    "postings as (select term, doc_id, length, count(*) as tf from tokens where term in (select term from asked) group by all), holders as (select term, count(*) as df from postings group by term), "
    "scored as (select query_id, p.doc_id as id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / mean))), 9) as score from asked join postings p using (term) join holders using (term) cross join size group by all)"
)


def _text_queries(spark, sf):
    return table(spark, sf, "benchmark").where(F.col("item_id") % QUERY_STEP == 0).select(F.col("item_id").alias("query_id"), "text")


_TOPK = f"with {_BM25}, ranked as (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored) select query_id, id, round(score, 6) as score, rank from ranked where rank <= 20"


@query("bm25_topk", _TOPK)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return fulltext.search(docs, _text_queries(spark, sf), 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("indexed_topk", _TOPK)
def _(spark, sf):
    """bm25_topk from a stored index: a first fold of all documents, every seventh with an old text; a second brings the present texts."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    index, old = TextIndex(spark, fresh_path(spark, "textindex")), F.col("id") % 7 == 0
    index.fold(docs.withColumn("text", F.when(old, F.reverse("text")).otherwise(F.col("text"))))
    index.fold(docs.where(old), docs.where(old))
    return index.search(_text_queries(spark, sf), 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _search_inputs(spark, sf):
    """Vector rows with their texts; queries from the benchmark with the vectors of their numbers."""
    rows = vectors(spark, sf).join(knowledge(spark, sf).select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").select(F.col("vec_id").alias("id"), "text", F.col("embedding").alias("vector"), "source_type", "authored_at")
    asked = _text_queries(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    return rows, asked


_HYBRID = (
    _VECTORS + ", q as (select b.item_id as query_id, b.text as query, e.embedding::double[] as qv from benchmark b join embeddings e on e.vec_id = b.item_id where b.item_id % 20 = 0), "
    "near as (select query_id, vec_id as id, 2 - 2 * round(list_dot_product(qv, v), 9) as distance, 0 as from_text, 0 as text_rank from q, vecs where source_type <> 'session' and vec_id <> query_id qualify row_number() over (partition by query_id order by round(list_dot_product(qv, v), 9) desc, vec_id) <= 20), "
    "asked as (select distinct query_id, unnest(" + _terms("query") + ") as term from q), listed as (select vec_id, source_type, " + _terms("text") + " as terms from vecs), "
    "size as (select count(*)::double as n, avg(len(terms)) as mean from listed), tokens as (select vec_id, source_type, len(terms) as length, unnest(terms) as term from listed), "
    "postings as (select term, vec_id, source_type, length, count(*) as tf from tokens where term in (select term from asked) group by all), holders as (select term, count(*) as df from postings group by term), "
    "scored as (select query_id, vec_id as id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / mean))), 9) as score from asked join postings using (term) join holders using (term) cross join size where source_type <> 'session' group by all), "
    "hits as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as text_rank from scored qualify text_rank <= 20), far as (select query_id, max(distance) as far from near group by 1), "
    "both_ as (select * from near union all select h.query_id, h.id, coalesce(far * 1.01::double, 1.0), 1, h.text_rank from hits h left join far using (query_id) where not exists (select 1 from near n where n.query_id = h.query_id and n.id = h.id)), "
    f"boosted as (select b.query_id, b.id, round(distance * {_BOOST} * {_RECENT}, 9) as boosted, from_text, text_rank, source_type, text from both_ b join vecs on vec_id = b.id), "
    "pool as (select *, row_number() over (partition by query_id order by boosted, from_text, text_rank, id) as position from boosted qualify position <= 20), "
    "judged as (select p.*, round(len(list_intersect(list_distinct(" + _terms("query") + "), list_distinct(" + _terms("text") + ")))::double / len(list_distinct(" + _terms("query") + ")), 9) as rerank_score from pool p join q using (query_id)), "
    "best as (select *, row_number() over (partition by query_id order by rerank_score desc, position) as rank from judged qualify rank <= 3)"
)


def _hybrid(spark, sf):
    rows, asked = _search_inputs(spark, sf)
    return retrieval.search(rows, asked, 3, recency_weight=WEIGHT, half_life=HALF_LIFE, now=NOW), asked


@query("hybrid_search", f"with {_HYBRID} select query_id, rank, id, source_type, substr(text, 1, 500) as preview, length(text) > 500 as truncated, round(boosted, 6) as score, round(rerank_score, 6) as rerank_score from best")
def _(spark, sf):
    found, _asked = _hybrid(spark, sf)
    return found.withColumn("score", F.round("score", 6)).withColumn("rerank_score", F.round("rerank_score", 6))


@query("search_confidence", f"with {_HYBRID} select q.query_id, case when max(rerank_score) is null then 'none' when max(rerank_score) < 0.3 then 'low' else 'high' end as confidence from q left join best using (query_id) group by 1")
def _(spark, sf):
    return retrieval.confidence(*_hybrid(spark, sf))


_EXPECTED = "expected as (select b.item_id as query_id, d.doc_id as id from benchmark b, documents d where b.item_id % 20 = 0 and contains(d.text, b.text))"


@query("retrieval_metrics", f"with {_BM25}, ranked as (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored), {_EXPECTED}, first_ as (select r.query_id, min(rank) as rank from ranked r join expected e on r.query_id = e.query_id and r.id = e.id where rank <= 5 group by 1), e_ as (select b.item_id, rank from benchmark b left join first_ on query_id = item_id where b.item_id % 20 = 0), m as (select count(*) as n, avg(case when rank <= 1 then 1.0 else 0.0 end) as h1, avg(case when rank <= 3 then 1.0 else 0.0 end) as h3, avg(case when rank <= 5 then 1.0 else 0.0 end) as h5, avg(coalesce(1.0::double / rank, 0.0)) as mrr from e_) select n, round(h1, 6) as hit_1, round(h3, 6) as hit_3, round(h5, 6) as hit_5, round(mrr, 6) as mrr, round(h1, 6) as text_match_1, round(0.4::double * mrr + 0.3::double * h1 + 0.3::double * h1, 6) as composite from m")
def _(spark, sf):
    docs, asked = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), _text_queries(spark, sf)
    return curation.ranked_metrics(fulltext.search(docs, asked, 5), curation.holders(docs, asked), asked)


_WANTED = "wanted as (select query_id, 'doc' || (query_id % 10) as expected_file, regexp_extract(query, '[A-Za-z]+') as expected_text from q)"


@query("search_evaluation", f"with {_HYBRID.replace('rank <= 3', 'rank <= 5')}, {_WANTED}, held as (select w.query_id, b.rank, contains(lower(b.text), lower(expected_text)) as ok from wanted w join best b using (query_id) join vecs on vec_id = b.id where contains(doc_path, expected_file)), first_ as (select query_id, min(rank) as rank, arg_min(ok, rank) as ok from held group by 1), e_ as (select w.query_id, rank, ok from wanted w left join first_ using (query_id)), m as (select count(*) as n, avg(case when rank <= 1 then 1.0 else 0.0 end) as h1, avg(case when rank <= 3 then 1.0 else 0.0 end) as h3, avg(case when rank <= 5 then 1.0 else 0.0 end) as h5, avg(coalesce(1.0::double / rank, 0.0)) as mrr, avg(case when rank = 1 and ok then 1.0 else 0.0 end) as tm from e_) select n, round(h1, 6) as hit_1, round(h3, 6) as hit_3, round(h5, 6) as hit_5, round(mrr, 6) as mrr, round(tm, 6) as text_match_1, round(0.4::double * mrr + 0.3::double * h1 + 0.3::double * tm, 6) as composite from m")
def _(spark, sf):
    rows, asked = _search_inputs(spark, sf)
    found = retrieval.search(rows, asked, 5, recency_weight=WEIGHT, half_life=HALF_LIFE, now=NOW)
    texts = knowledge(spark, sf).select(F.col("doc_id").alias("id"), "doc_path", "text")
    wanted = asked.select("query_id", F.concat(F.lit("doc"), (F.col("query_id") % 10).cast("string")).alias("expected_file"), F.regexp_extract("text", "[A-Za-z]+", 0).alias("expected_text"))
    return curation.evaluated(found.select("query_id", "rank", "id").join(texts, "id"), wanted)


# deduplication


@query("exact_dedup_donor", f"with {_KNOWLEDGE}, h as (select *, {_HASH} as content_hash from knowledge), f as (select *, min(case when source_type <> 'session' then doc_id end) over (partition by content_hash) as first_donor from h) select doc_id, content_hash, coalesce(first_donor, -1) as first_donor, first_donor is null or doc_id <= first_donor as kept from f")
def _(spark, sf):
    rows = knowledge(spark, sf).select("doc_id", "doc_path", "source_type", F.col("doc_id").alias("seq"), X.content_hash(F.col("text")).alias("content_hash"))
    return curation.with_donors(rows).select("doc_id", "content_hash", F.coalesce("first_donor", F.lit(-1)).alias("first_donor"), "kept")


@query("hash_documents", f"with {_KNOWLEDGE} select {_HASH} as content_hash, count(distinct doc_path) as n_docs, min(doc_path) as first_path, max(doc_path) as last_path from knowledge group by 1")
def _(spark, sf):
    return curation.hash_documents(knowledge(spark, sf).withColumn("content_hash", X.content_hash(F.col("text"))))


@query("near_dupes", f"with {_VECTORS}, {_SIMILAR} select query_id, id, round(similarity, 6) as similarity from pairs where similarity >= 0.9")
def _(spark, sf):
    rows = vectors(spark, sf)
    return similarity.similar(_base(rows), _vector_queries(rows), least=0.9).withColumn("similarity", F.round("similarity", 6))


@query("near_dupe_warnings", f"with {_VECTORS}, {_SIMILAR}, w as (select q.doc_path, p.query_id, p.id, p.similarity, row_number() over (partition by q.doc_path order by p.query_id, p.similarity desc, p.id) as place from pairs p join vecs q on q.vec_id = p.query_id where p.similarity >= 0.3) select doc_path, place, query_id, id, round(similarity, 6) as similarity from w where place <= 5")
def _(spark, sf):
    rows = vectors(spark, sf)
    asked = rows.where(F.col("vec_id") % QUERY_STEP == 0).select("doc_path", F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return similarity.near_duplicates(_base(rows), asked, 0.3).withColumn("similarity", F.round("similarity", 6))


@query("nn_fact_match", f"with {_VECTORS}, {_SIMILAR} select query_id, id, round(similarity, 6) as similarity from (select * from pairs qualify row_number() over (partition by query_id order by similarity desc, id) = 1) where similarity >= 0.4")
def _(spark, sf):
    rows = vectors(spark, sf)
    return similarity.nearest(_base(rows), _vector_queries(rows)).withColumn("similarity", F.round("similarity", 6))


@query("unit_vectors", "select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: x * x)), 6) as square, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as first_axis from embeddings")
def _(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rows.select("vec_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("square"), F.round(F.get(V.normalised(F.col("embedding")), F.lit(0)), 6).alias("first_axis"))


@query("recent_vectors", "select vec_id, label from embeddings order by vec_id desc limit 500")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label").orderBy(F.desc("vec_id")).limit(500)


@query("ingest_warnings", "with c as (select vec_id, 'doc' || (vec_id // 5) as doc_path, vec_id % 5 as chunk_index, vec_id::varchar as chunk_id, embedding::double[] as v from embeddings), late as (select chunk_id as near_id, v from c qualify row_number() over (order by vec_id desc) <= 500), lead as (select * from c qualify row_number() over (partition by doc_path order by chunk_index, chunk_id) <= 3), p as (select doc_path, chunk_id, near_id, round(list_dot_product(lead.v, late.v), 9) as s from lead join late on chunk_id <> near_id), near as (select * from p where s >= 0.3 qualify row_number() over (partition by doc_path, chunk_id order by s desc, near_id) <= 5) select doc_path, row_number() over (partition by doc_path order by s desc, chunk_id, near_id) as place, chunk_id, near_id, round(s, 6) as similarity from near qualify place <= 5")
def _(spark, sf):
    """Five vectors make a document; its first three are compared with the 500 that came last (0.9 and more, what an ingest warns of, occurs in no table here)."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("doc"), F.floor(F.col("vec_id") / 5)).alias("doc_path"), (F.col("vec_id") % 5).alias("chunk_index"), F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"))
    found = near_rows(rows, rows.orderBy(F.desc("vec_id")).limit(500), least=0.3)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("tiered_topk", f"with {_VECTORS}, {_SIMILAR} select query_id, id, round(2 - 2 * similarity, 6) as distance from pairs where source_type <> 'session' and id % 10 <> 0 qualify row_number() over (partition by query_id order by similarity desc, id) <= 10")
def _(spark, sf):
    """Every tenth vector stands for a summary (tier 1); only leaves are searched."""
    rows = vectors(spark, sf).withColumn("tier", F.when(F.col("vec_id") % 10 == 0, 1).otherwise(0))
    return similarity.similar(_base(retrieval.searched(rows, "session", 0)), _vector_queries(rows), k=10).select("query_id", "id", F.round(2 - 2 * F.col("similarity"), 6).alias("distance"))


# catalogue


def _manifest(spark, sf, rows=None):
    """A manifest that misses some documents, holds old hashes of others, and some files that are gone. rows: the documents' hashes, if they are there."""
    rows = knowledge(spark, sf).withColumn("content_hash", X.content_hash(F.col("text"))) if rows is None else rows
    digest = F.when(F.col("doc_id") % 11 == 0, F.md5("doc_path")).otherwise(F.col("content_hash"))
    held = rows.where(F.col("doc_id") % 7 != 0).select(F.col("doc_path").alias("path"), digest.alias("content_hash"))
    gone = rows.where(F.col("doc_id") % 13 == 0).select(F.concat(F.lit("gone/"), "doc_path").alias("path"), F.lit("x").alias("content_hash"))
    return held.unionByName(gone)


_MANIFEST = f"manifest as (select doc_path as path, case when doc_id % 11 = 0 then md5(doc_path) else {_HASH} end as content_hash from knowledge where doc_id % 7 <> 0 union all select 'gone/' || doc_path, 'x' from knowledge where doc_id % 13 = 0)"
_DIFF = f"{_KNOWLEDGE}, {_MANIFEST}, now_ as (select doc_path as path, {_HASH} as h from knowledge), diff as (select coalesce(n.path, m.path) as path, case when m.path is null then 'new' when n.path is null then 'deleted' when n.h <> m.content_hash then 'modified' else 'unchanged' end as status from now_ n full outer join manifest m on n.path = m.path)"


def _diff(spark, sf):
    files = knowledge(spark, sf).select(F.col("doc_path").alias("path"), X.content_hash(F.col("text")).alias("content_hash"))
    return curation.diff(files, _manifest(spark, sf))


@query("diff_files", f"with {_DIFF} select path, status from diff")
def _(spark, sf):
    return _diff(spark, sf)


@query("ingest_counts", f"with {_DIFF} select status, count(*) as n, min(path) as first_path, (select string_agg(path, ' ' order by path) from (select path from diff e where e.status = d.status order by path limit 10)) as details from diff d group by status")
def _(spark, sf):
    rows = _diff(spark, sf)
    ten = rows.withColumn("n", F.row_number().over(Window.partitionBy("status").orderBy("path"))).where("n <= 10")
    details = ten.groupBy("status").agg(F.array_join(F.array_sort(F.collect_list("path")), " ").alias("details"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).join(details, "status")


@query("delete_documents", f"with {_DIFF} select k.doc_id, k.doc_path from knowledge k where k.doc_path not in (select path from diff where status in ('modified', 'deleted'))")
def _(spark, sf):
    gone = _diff(spark, sf).where("status in ('modified', 'deleted')")
    return curation.without_paths(knowledge(spark, sf), gone).select("doc_id", "doc_path")


@query("index_stats", f"with {_KNOWLEDGE} select source_type, count(*) as n_rows, count(distinct doc_path) as n_docs, min(authored_at) as oldest, max(authored_at) as newest from knowledge group by source_type")
def _(spark, sf):
    return knowledge(spark, sf).groupBy("source_type").agg(F.count("*").alias("n_rows"), F.countDistinct("doc_path").alias("n_docs"), F.min("authored_at").alias("oldest"), F.max("authored_at").alias("newest"))


@query("tier_stats", f"with {_KNOWLEDGE} select (case when doc_id % 10 = 0 then 1 else 0 end)::int as tier, count(*) as n_rows, count(distinct doc_path) as n_docs from knowledge group by 1")
def _(spark, sf):
    return catalog.tier_counts(knowledge(spark, sf).withColumn("tier", F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)))


def _store(spark, sf):
    """A store of one row a document: all but every eleventh come first, then every seventh anew and those left out, while every thirteenth goes."""
    store, rows = ChunkStore(spark, fresh_path(spark, "store")), knowledge(spark, sf).repartition("doc_path")
    made = {"chunk_id": F.col("doc_id").cast("string"), "tier": F.lit(0), "chunk_index": F.lit(0), "content_hash": X.content_hash(F.col("text")), "created_at": F.lit(NOW).cast("timestamp_ntz"), "doc_id": X.document_key(F.col("doc_path"))}
    chunks = rows.withColumn("number", F.col("doc_id")).withColumns(made)
    chunks = chunks.select("number", *[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in chunks.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CHUNK_SCHEMA])
    entries = lambda some, now: some.select(F.col("doc_path").alias("path"), "content_hash", F.lit(1).alias("chunk_count"), F.lit(BEFORE).alias("ingested_at"), F.lit(now).alias("updated_at"), F.lit(0).alias("retrieval_count"))
    chunks = written(chunks, "incoming")
    first, second = chunks.where("number % 11 <> 0"), chunks.where("(number % 7 = 0 or number % 11 = 0) and number % 13 <> 0")
    store.apply(first, first.select(F.col("doc_path").alias("path")).limit(0), entries(first, BEFORE), ["number"])
    store.apply(second, chunks.where("number % 13 = 0").select(F.col("doc_path").alias("path")), entries(second, NOW), ["number"])
    return store


_STORED = (
    f"{_KNOWLEDGE}, f as (select doc_id, doc_path, row_number() over (order by doc_id) - 1 as s from knowledge where doc_id % 11 <> 0), l as (select doc_path, (select count(*) from f) + row_number() over (order by doc_id) - 1 as s from knowledge where (doc_id % 7 = 0 or doc_id % 11 = 0) and doc_id % 13 <> 0), "
    f"stored as (select doc_path, s as ingest_seq, '{BEFORE}' as updated_at from f where doc_id % 13 <> 0 and doc_id % 7 <> 0 union all select doc_path, s, '{NOW}' from l)"
)


@query("stored_rows", f"with {_STORED} select doc_path, ingest_seq, updated_at from stored")
def _(spark, sf):
    store = _store(spark, sf)
    return store.chunks().select("doc_path", "ingest_seq").join(store.manifest().select(F.col("path").alias("doc_path"), "updated_at"), "doc_path")


@query("store_tail", f"with {_STORED} select doc_path, ingest_seq from stored order by ingest_seq desc limit 500")
def _(spark, sf):
    return _store(spark, sf).tail(500).select("doc_path", "ingest_seq")


#: Each event counts as a retrieval of the document with its user's number.
_SERVED = f"{_KNOWLEDGE}, r as (select user_id as doc_id, count(*) as retrievals from events group by 1), s as (select doc_path, source_type, len({_words('text')}) as n, coalesce(retrievals, 0) as retrievals from knowledge left join r using (doc_id))"


def _served(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("retrievals"))
    rows = knowledge(spark, sf).select("doc_id", "doc_path", "source_type", F.size(X.words(F.col("text"))).cast("long").alias("n"))
    return rows.join(counts, "doc_id", "left").withColumn("retrievals", F.coalesce("retrievals", F.lit(0)))


@query("manifest_stats", f"with {_SERVED} select count(*) as n_files, sum(n)::bigint as n_words, max(n)::bigint as longest, sum(retrievals)::bigint as n_retrievals from s")
def _(spark, sf):
    return _served(spark, sf).agg(F.count("*").alias("n_files"), F.sum("n").alias("n_words"), F.max("n").alias("longest"), F.sum("retrievals").alias("n_retrievals"))


@query("list_files", f"with {_SERVED}, k as (select source_type, count(*) as n_rows from s group by 1) select (select count(*) from s) as store_rows, (select count(distinct doc_path) from s) as store_docs, (select string_agg(source_type || '=' || n_rows, ' ' order by source_type) from k) as by_type, (select sum(retrievals)::bigint from s) as n_retrievals, (select string_agg(doc_path, ' ' order by retrievals desc, doc_path) from (select * from s order by retrievals desc, doc_path limit 10)) as top_retrieved")
def _(spark, sf):
    rows = _served(spark, sf)
    store = rows.agg(F.count("*").alias("store_rows"), F.countDistinct("doc_path").alias("store_docs"), F.sum("retrievals").alias("n_retrievals"))
    kinds = rows.groupBy("source_type").agg(F.count("*").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source_type", F.col("k").cast("string")))), " ").alias("by_type"))
    first = rows.orderBy(F.desc("retrievals"), "doc_path").limit(10).agg(F.array_sort(F.collect_list(F.struct((-F.col("retrievals")).alias("r"), "doc_path"))).alias("t"))
    return store.crossJoin(kinds).crossJoin(first).select("store_rows", "store_docs", "by_type", "n_retrievals", F.array_join("t.doc_path", " ").alias("top_retrieved"))  # one row each


@query("top_retrieved", "select user_id, count(*) as retrievals from events group by user_id order by retrievals desc, user_id limit 10")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("retrievals")).orderBy(F.desc("retrievals"), "user_id").limit(10)


@query("retrieval_counts", "select user_id, event_type, count(*) as retrievals, count(*) // 25 as flushes from events group by user_id, event_type")
def _(spark, sf):
    counted = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("retrievals"))
    return counted.withColumn("flushes", F.floor(F.col("retrievals") / 25))


@query("best_run", "select event_type, user_id, event_id, value from events qualify row_number() over (partition by event_type, user_id order by value desc, event_id) = 1")
def _(spark, sf):
    best = F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("event_id"))).alias("best")
    return table(spark, sf, "events").groupBy("event_type", "user_id").agg(best).select("event_type", "user_id", "best.event_id", "best.value")


@query("history_newest", "select event_id, ts, event_type from events where contains(event_type, 'c') order by ts desc, event_id desc limit 10")
def _(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").contains("c")).orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "ts", "event_type").limit(10)


@query("history_best", "select event_id, event_type, value, row_number() over (order by value desc, event_id) as place from events qualify place <= 10")
def _(spark, sf):
    ten = table(spark, sf, "events").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "event_type", "value")
    return ten.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "event_id")))


@query("history_last", "select event_id, ts, value from events order by ts desc, event_id desc limit 25")
def _(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "ts", "value")


@query("retrieval_log", "select user_id, event_type, count(*) as retrievals, max(ts) as last_at, (select count(*) from events e where e.user_id = v.user_id) as user_total from events v group by user_id, event_type")
def _(spark, sf):
    # an append-only log of single retrievals, compacted to sums
    log = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("retrievals"), F.max("ts").alias("last_at"))
    return log.join(log.groupBy("user_id").agg(F.sum("retrievals").alias("user_total")), "user_id")


@query("result_shape", "select doc_id, substr(text, 1, 500) as preview, length(text) > 500 as truncated from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 500).alias("preview"), (F.length("text") > 500).alias("truncated"))


# sessions


@query("pending_by_project", f"with {_KNOWLEDGE} select case when contains(doc_path, 'vault/library/sessions/') then 'library' else split_part(doc_path, '/', -4) end as project, count(*) as pending from knowledge where source_type = 'session' group by 1")
def _(spark, sf):
    return sessions.pending(knowledge(spark, sf))


@query("ripe_projects", f"with {_KNOWLEDGE}, p as (select case when contains(doc_path, 'vault/library/sessions/') then 'library' else split_part(doc_path, '/', -4) end as project, count(*) as pending from knowledge where source_type = 'session' group by 1) select string_agg(project, ', ' order by project) as projects, count(*) as n from p where pending >= 5")
def _(spark, sf):
    ripe = sessions.pending(knowledge(spark, sf)).where("pending >= 5")
    return ripe.agg(F.array_join(F.array_sort(F.collect_list("project")), ", ").alias("projects"), F.count("*").alias("n"))


_NOISE = " or ".join(f"starts_with(lower(text), {_sql_text(n)})" for n in sessions.NOISE)
_SAID = f"t0 as (select conv_id, turn, role, {_strip('text')} as text from conversations where role in ('user', 'assistant')), t as (select * from t0 where text <> '' and not (role = 'user' and ({_NOISE}))), said as (select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id, role order by turn) as a, row_number() over (partition by conv_id, role order by turn desc) as d from t) where (role = 'user' and a <= 12) or (role = 'assistant' and d <= 40))"


@query("transcript_turns", f"with {_SAID} select conv_id, turn, role, text from said")
def _(spark, sf):
    return sessions.bounded_turns(table(spark, sf, "conversations"), "conv_id")


def _matches(text: str, pattern: str, group: int = 0) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, {_sql_text(pattern)}, {group}), lambda m: substr({_strip('m')}, 1, 300)), lambda m: m <> '')"


#: The path pattern without its look-behind, which this dialect lacks.
_PATHS = "(?:^|[^A-Za-z0-9])(" + X.FILE_PATH.removeprefix("(?<![A-Za-z0-9])") + ")"
_CAPTURED = (
    _SAID + ", g as (select conv_id, coalesce(list(text order by turn) filter (where role = 'user'), []::varchar[]) as users, coalesce(list(text order by turn) filter (where role = 'assistant'), []::varchar[]) as own from said group by conv_id), "
    f"m as (select *, {_matches(chr(97) + 'rray_to_string(own, chr(10))', X.DECISION)} as d0, {_matches('array_to_string(own, chr(10))', X.ACTION)} as a0, {_matches('array_to_string(own, chr(10)) || chr(10) || array_to_string(users, chr(10))', _PATHS, 1)} as f0, substr({_strip('regexp_split_to_array(users[1], ' + _sql_text(X.LINE) + ')[1]')}, 1, 80) as t0 from g), "
    f"x as (select conv_id, case when coalesce(t0, '') = '' then 'session' else t0 end as title, substr(users[1], 1, 600) as task, substr(own[len(own)], 1, 600) as outcome, list_slice({_distinct('d0')}, 1, 8) as ds, list_slice({_distinct('a0')}, 1, 10) as acts, list_slice({_distinct('f0')}, 1, 20) as fs from m)"
)
_LISTED = ", ".join(f"array_to_string(list_transform({c}, lambda v: {_scrub('v')}), chr(10)) as {name}" for c, name in (("ds", "decisions"), ("acts", "actions"), ("fs", "files")))


@query("session_captures", f"with {_CAPTURED} select conv_id, case when {_strip(_scrub('title'))} = '' then 'session' else {_strip(_scrub('title'))} end as title, {_scrub('task')} as task, {_scrub('outcome')} as outcome, {_LISTED} from x")
def _(spark, sf):
    found = sessions.capture(table(spark, sf, "conversations"), "conv_id")
    return found.select("conv_id", "title", "task", "outcome", *[F.array_join(c, "\n").alias(c) for c in ("decisions", "actions", "files")])


def _transcript(spark, sf):
    """conversations as transcript lines: a system turn is a side chain, and some lines have no folder or branch."""
    said = table(spark, sf, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    return said.select(
        conv.alias("file"), turn.alias("line"), F.col("role").alias("type"), F.concat(F.lit("session-"), conv).alias("session"),
        F.when(turn % 2 == 1, F.concat(F.lit("repos/p"), (F.col("conv_id") % 7).cast("string"), F.lit("/src"))).otherwise("").alias("cwd"),
        F.when(turn > 0, F.concat(F.lit("branch-"), turn.cast("string"))).alias("branch"), (F.col("role") == "system").alias("sidechain"), F.array("text").alias("texts"), (F.col("conv_id") % 11 == 0).alias("captured"),
    )


_META = "l as (select conv_id::varchar as file, turn, role = 'system' as side, 'session-' || conv_id as session, case when turn % 2 = 1 then 'repos/p' || conv_id % 7 || '/src' else '' end as cwd, case when turn > 0 then 'branch-' || turn else '' end as branch, conv_id % 11 = 0 as captured from conversations)"
_FIRST = ", ".join(f"coalesce(min_by({c}, turn) filter (where not side and {c} <> ''), '') as {name}" for c, name in (("session", "session_id"), ("cwd", "cwd"), ("branch", "branch")))


@query("session_metadata", f"with {_META} select file, {_FIRST}, bool_or(captured) as captured from l group by file")
def _(spark, sf):
    return sessions.metadata(_transcript(spark, sf))


@query("session_notes")
def _(spark, sf):
    held = table(spark, sf, "conversations").where("conv_id % 5 = 0").select(F.concat(F.lit("repos/p"), (F.col("conv_id") % 7).cast("string"), F.lit("/research/sessions/2025-01-01-000000-"), F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8), F.lit(".md")).alias("path")).distinct()
    lines = _transcript(spark, sf).withColumn("session", F.md5("file"))
    return sessions.capture_sessions(lines, held, NOW)


def _memory_calls(spark, sf):
    said = table(spark, sf, "conversations")
    return said.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("seq"), F.col("text").alias("content"), F.substring("text", 1, 60).alias("title"), F.when(F.col("turn") % 3 == 0, F.col("role")).when(F.col("turn") % 3 == 1, "not/safe").alias("project"), F.when(F.col("turn") % 2 == 0, "session").otherwise("note").alias("kind"), F.md5(F.col("conv_id").cast("string")).alias("session_id"), F.lit("repos/p1/src").alias("cwd"))


@query("memory_notes")
def _(spark, sf):
    return sessions.capture_memories(_memory_calls(spark, sf), None, NOW)


@query("recent_sessions", f"with {_KNOWLEDGE} select regexp_replace(doc_path, '^vault/library/sessions/[^/]+/', 'vault/library/sessions/') as path, authored_at as modified from knowledge where regexp_matches(regexp_replace(doc_path, '^vault/library/sessions/[^/]+/', 'vault/library/sessions/'), '^(repos/[^/]+/research/sessions|vault/library/sessions)/[^/]*[.]md$') and authored_at >= timestamp '{NOW}' - interval 420 days")
def _(spark, sf):
    files = knowledge(spark, sf).withColumn("doc_path", F.regexp_replace("doc_path", "^vault/library/sessions/[^/]+/", "vault/library/sessions/")).select(F.col("doc_path").alias("path"), F.col("authored_at").alias("modified"))
    return sessions.recent_sessions(files, None, 420, NOW)


@query("decision_lines", f"with m as (select conv_id, turn, {_matches('text', X.DECISION)} as d0, {_matches('text', X.ACTION)} as a0 from conversations) select conv_id, turn, array_to_string(list_slice({_distinct('d0')}, 1, 8), chr(10)) as decisions, array_to_string(list_slice({_distinct('a0')}, 1, 10), chr(10)) as actions from m")
def _(spark, sf):
    text = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.first_matches(text, X.DECISION, 8), "\n").alias("decisions"), F.array_join(X.first_matches(text, X.ACTION, 10), "\n").alias("actions"))


_PACKED = "l as (select conv_id, turn, length(text) as length from conversations), b as (select *, coalesce(sum(length) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as before from l)"


@query("budget_pack", f"with {_PACKED} select conv_id, turn, least(length, greatest(1000 - before, 0))::bigint as used, case when before >= 1000 then 'pending' when length > 1000 - before then 'clamped' else 'taken' end as status from b")
def _(spark, sf):
    reports = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("length"))
    return curation.within_budget(reports, "conv_id", ["turn"], 1000).select("conv_id", "turn", F.col("used").cast("long").alias("used"), "status")


@query("bloat_guard", "with s as (select source, sum(length(text))::bigint as merged, sum(case when doc_id % 2 = 0 then length(text) else 0 end)::bigint // 4 as existing, sum(case when doc_id % 2 = 1 then length(text) else 0 end)::bigint // 4 as new_ from documents group by source) select source, merged > greatest(2 * existing, 2000) and merged > existing + new_ as bloated from s")
def _(spark, sf):
    size = F.length("text").cast("long")
    sums = table(spark, sf, "documents").groupBy("source").agg(F.sum(size).alias("merged"), F.floor(F.sum(F.when(F.col("doc_id") % 2 == 0, size).otherwise(0)) / 4).alias("existing"), F.floor(F.sum(F.when(F.col("doc_id") % 2 == 1, size).otherwise(0)) / 4).alias("new"))
    return sums.select("source", curation.bloated(F.col("merged"), F.col("existing"), F.col("new")).alias("bloated"))


_PROJECT = "case when contains(doc_path, 'vault/library/sessions/') then 'library' else split_part(doc_path, '/', -4) end"
_REPORTS = (
    _KNOWLEDGE + f", r as (select {_PROJECT} as project, doc_path, text, length(text) as length from knowledge where source_type = 'session'), b as (select *, coalesce(sum(length) over (partition by project order by doc_path rows between unbounded preceding and 1 preceding), 0)::bigint as before from r), "
    f"c as (select project, doc_path, substr(text, 1, least(length, greatest({sessions.curation.BUDGET} - before, 0))) as text, least(length, greatest({sessions.curation.BUDGET} - before, 0)) as used, case when before >= {sessions.curation.BUDGET} then 'pending' when length > {sessions.curation.BUDGET} - before then 'clamped' else 'taken' end as status from b), "
    f"u as (select *, {_UNITS} as units from c)"
)
_BODY = "array_to_string(flatten(list(units order by doc_path) filter (where status <> 'pending')), chr(10))"


@query("consolidated_notes", f"with {_REPORTS} select project, {_scrub(_BODY)} as body, count(*) filter (where status <> 'pending') as n_sources, count(*) filter (where status = 'pending') as n_pending, count(*) filter (where status = 'clamped') as n_clamped, sum(used)::bigint as used from u group by project")
def _(spark, sf):
    rows = knowledge(spark, sf).where("source_type = 'session'")
    return sessions.consolidated(rows.select(X.session_project(F.col("doc_path")).alias("project"), "doc_path", "text"))


@query("pruned_sources", f"with {_REPORTS} select project, doc_path as path from u where status <> 'pending' and regexp_matches(doc_path, '^repos/[^/]+/research/sessions/[^/]*[.]md$')")
def _(spark, sf):
    """Sessions that leave the store with the coming of their projects' notes."""
    files = knowledge(spark, sf).select(F.col("doc_path").alias("path"), "text", F.col("authored_at").alias("modified"))
    return memory.consolidate_sessions(_store(spark, sf), files, NOW)[2]


@query("consolidation")
def _(spark, sf):
    rows = knowledge(spark, sf).where("source_type = 'session'").select(X.session_project(F.col("doc_path")).alias("project"), "doc_path", "text")
    # notes of an earlier run over the older reports of some projects
    early = sessions.consolidate(rows.where("crc32(doc_path) % 4 = 0"), rows.select("project", "text").limit(0), "2025-01-01")
    notes = written(early.where("note is not null").select("project", F.col("note").alias("text")), "notes")
    return sessions.consolidate(rows.where("crc32(doc_path) % 4 <> 0"), notes, "2025-03-01")


_FACTS = (
    f"u as (select conv_id, turn, {_UNITS} as units from conversations), n as (select conv_id, turn, units, len(units) as k, unnest(range(0, least(len(units), 120))) as i from u), f0 as (select distinct conv_id, turn, i, {_FACT} as fact from n), "
    f"f1 as (select conv_id, ('0x' || substr(md5(conv_id || '|' || turn || '|' || i || '|' || fact), 1, 15))::bigint as id, fact, {_places('fact')} as ps from f0), f2 as (select conv_id, id, fact, {_COUNTS} as c from f1), f as (select conv_id, id, fact, {_UNIT} as v from f2)"
)
_REVERSAL = "regexp_matches(lower({}), '\\b(?:" + "|".join(models.TRIGGERS) + ")\\b')"


@query(
    "contradictions",
    f"with {_FACTS}, pairs as (select b.fact as newer, b.id as query_id, a.fact as prior, a.id, round(list_dot_product(a.v, b.v), 9) as s from f a join f b on a.id <> b.id where b.conv_id % 20 = 0), near as (select * from pairs qualify row_number() over (partition by query_id order by s desc, id) = 1) select prior, newer, case when {_REVERSAL.format('prior')} <> {_REVERSAL.format('newer')} then 0.95::double else 0.0::double end as confidence from near where s >= 0.4",
)
def _(spark, sf):
    said = table(spark, sf, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    name = F.concat_ws("|", F.col("id.conv_id").cast("string"), F.col("id.turn").cast("string"), F.col("n").cast("string"), "fact")
    # a repeated row counts once, for ids must be distinct
    units = sessions.facts(said.select("id", "text").repartition("id")).select("id.conv_id", F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("id"), "fact").dropDuplicates(["id"])
    units = written(units, "units")
    return sessions.contradictions(units, units.where(F.col("conv_id") % QUERY_STEP == 0), least=0.0)


_TOKENS = f"t as (select doc_id, cast(floor(len({_words('text')}) * 1.3::double) as int) as reports, doc_id % 30000 as existing from documents)"


@query("prompt_budget", f"with {_TOKENS}, b as (select *, existing > 0 and reports <= 28160 - 300 as both_ from t), k as (select *, case when both_ then least(existing, 28160 - 300 - reports) else 0 end as kept from b) select doc_id, case when both_ and kept > 0 then reports else least(reports, 28160 - 200) end as reports, kept as existing, both_ and kept > 0 as update_ from k")
def _(spark, sf):
    found = models.prompt_budget(X.token_estimate(F.col("text")), (F.col("doc_id") % 30000).cast("int"), 4096, 300, 200)
    return table(spark, sf, "documents").select("doc_id", found.alias("b")).select("doc_id", "b.reports", "b.existing", F.col("b.update").alias("update_"))


# chunks and clusters


@query("chunk_documents")
def _(spark, sf):
    return chunking.chunks(knowledge(spark, sf).select("doc_id", "doc_path", "source_type", "text"))


def _files(spark, sf):
    return knowledge(spark, sf).withColumn("seq", F.col("doc_id"))


def _once(function):
    """What a function makes for a folder is made once in an application."""
    made = {}

    @functools.wraps(function)
    def run(spark, sf):
        key = (spark.sparkContext.applicationId, sf)
        if key not in made:
            made[key] = function(spark, sf)
        return made[key]

    return run


@_once
def _stored(spark, sf):
    """The chunk table of the manifest's files, as a first sync of them wrote it."""
    hashed = _digests(spark, sf)

    def held(files):
        gone = files.where(F.col("doc_id") % 13 == 0).withColumn("doc_path", F.concat(F.lit("gone/"), "doc_path"))
        return files.where(F.col("doc_id") % 7 != 0).unionByName(gone)

    nothing = _manifest(spark, sf, hashed).limit(0)
    return written(catalog.sync(held(_files(spark, sf)), nothing, None, BEFORE, hashed=held(hashed))[0], "stored")


@_once
def _digests(spark, sf):
    return catalog.digests(knowledge(spark, sf).select("doc_id", "doc_path", "text"))


@query("chunk_table")
def _(spark, sf):
    return catalog.chunk_rows(_files(spark, sf), NOW)


@query("sync_index")
def _(spark, sf):
    return _synced(spark, sf)[2]


@_once
def _synced(spark, sf):
    hashed = _digests(spark, sf)
    before = _manifest(spark, sf, hashed)
    chunks, statuses = catalog.sync(_files(spark, sf), before, _stored(spark, sf), NOW, hashed=hashed)
    return hashed, before, written(chunks, "chunks"), statuses


@query("sync_outcomes")
def _(spark, sf):
    files, _, chunks, statuses = _synced(spark, sf)
    return catalog.file_statuses(files, statuses, chunks)


@query("sync_manifest")
def _(spark, sf):
    files, before, chunks, statuses = _synced(spark, sf)
    return catalog.sync_manifest(files, before, chunks, statuses, NOW)


@query("sync_report")
def _(spark, sf):
    files, _, chunks, statuses = _synced(spark, sf)
    return catalog.sync_report(catalog.file_statuses(files, statuses, chunks), statuses, sessions.pending(knowledge(spark, sf)))


@query("rebuilt_summaries")
def _(spark, sf):
    leaves = catalog.chunk_rows(_files(spark, sf), BEFORE).drop("seq")
    return clusters.rebuilt(written(leaves, "leaves"), NOW).where("tier = 1").select("doc_path", "cluster_id", F.array_join("parent_id", ",").alias("parents"), "heading", "text", "token_count", "source_type")


@query("summary_sweep")
def _(spark, sf):
    return clusters.sweep(_chunked(spark, sf), [(0.4, 3), (0.5, 3), (0.6, 3), (0.7, 3), (0.8, 3), (1.0, 3), (0.6, 2), (0.6, 5), (0.8, 2), (0.8, 5)])


@query("scored_sweep")
def _(spark, sf):
    """Questions are the texts of every twentieth document's first chunk; that document is what they ask for."""
    rows = written(_chunked(spark, sf), "chunked")
    first = rows.where("chunk_index = 0").select(F.regexp_extract("doc_path", "doc([0-9]+)[.]md$", 1).cast("long").alias("query_id"), "vector", F.regexp_extract("doc_path", "doc[0-9]+[.]md$", 0).alias("expected_file"), F.lit("").alias("expected_text"))
    return clusters.scored_sweep(rows, first.where(F.col("query_id") % QUERY_STEP == 0), [(0.4, 3), (0.6, 3), (0.8, 3), (0.8, 5)])


@query("embed_documents", f"with e0 as (select doc_id, {_places('text')} as ps from documents), e as (select doc_id, {_COUNTS} as c from e0), v as (select doc_id, {_UNIT} as v from e) select doc_id, array_to_string(list_transform(v, lambda x: round(x * 10000)::int), ',') as vector from v")
def _(spark, sf):
    vector = F.transform(models.embed("text"), lambda x: F.round(x.cast("double") * 10000).cast("int").cast("string"))
    return table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.array_join(vector, ",").alias("vector"))


def _chunked(spark, sf):
    rows = chunking.chunks(knowledge(spark, sf).select("doc_path", "source_type", "text"))
    return rows.withColumn("vector", models.embed("text")).withColumn("chunk_id", X.chunk_key(F.col("doc_path"), F.col("chunk_index"), F.col("content_hash")))


@query("cluster_chunks")
def _(spark, sf):
    return clusters.clusters(_chunked(spark, sf))


@query("cluster_summaries")
def _(spark, sf):
    return clusters.summaries(_chunked(spark, sf))


@query("streamed_stats", f"with {_KNOWLEDGE} select source_type, count(*) as n_rows from knowledge group by source_type")
def _(spark, sf):
    from foliant.streaming import stats

    return stats.streamed_stats(spark, f"{sf}/documents.parquet")
