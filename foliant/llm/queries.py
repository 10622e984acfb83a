"""Registered queries of the corpus operators: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def near_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import near_items

    return near_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_tree import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import page_languages

    return page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import passages

    return passages(table(spark, sf_dir, "documents")).select("doc_id", "start_word", "end_word", "n_words")


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pfor import token_file

    return token_file(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxsketch import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import verified

    return verified(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_retrieval_packing": op8_retrieval_packing,
    "op9_token_binary": op9_token_binary,
    "op10_simhash_near_dup": op10_simhash_near_dup,
    "op11_ranked_search": op11_ranked_search,
    "op12_minhash_near_dup": op12_minhash_near_dup,
    "op13_merkle_manifest": op13_merkle_manifest,
    "near_benchmark_items": near_benchmark_items,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _merkle_sql(levels: int = 8, top_levels: int = 3) -> str:
    """SQL of op13 for up to 8 ** levels rows of a language and 8 ** top_levels languages."""

    def tree(name: str, key: str, leaves: str, high: int) -> str:
        """Tables <name>0, <name>1, … of nodes (key, n, pos, h, l, r), l and r the digests beside a node in its run, and <name>top."""
        run = f"partition by {key}, pos // 8 order by pos rows between"
        sides = f"coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as r"
        out = [f"{name}0 as (select *, {sides} from ({leaves}))"]
        for k in range(high):
            up = f"select {key}, (any_value(n) + 7) // 8 as n, pos // 8 as pos, sha256(string_agg(h, '' order by pos)) as h from {name}{k} where n > 1 group by {key}, pos // 8"
            out.append(f"{name}{k + 1} as (select *, {sides} from ({up}))")
        tops = " union all ".join(f"select {key}, h from {name}{k} where n = 1" for k in range(high + 1))
        return ", ".join([*out, f"{name}top as ({tops})"])

    def climbed(before: str, name: str, key: str, pos: str, high: int, to: str) -> str:
        """Tables that fold f and gather the siblings s along the levels of a tree."""
        out = []
        for k in range(high):
            step = f"select b.* exclude (f, s), case when t.n > 1 then sha256(t.l || b.f || t.r) else b.f end as f, case when t.n > 1 then b.s || t.l || t.r else b.s end as s"
            here = to if k == high - 1 else f"{to}{k}"
            out.append(f"{here} as ({step} from {before} b left join {name}{k} t on t.{key} is not distinct from b.{key} and t.pos = b.{pos} // {8**k})")
            before = here
        return ", ".join(out)

    said = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(said, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    bits = "flatten(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: list_transform(range(0, 8), lambda k: (ascii(substr(doc_id::varchar, i::int, 1)) >> k::int)::bigint & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], {bits}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"
    lower = f"case when {crc} % 3 = 0 then translate(text, '{_UPPER}', '{_UPPER.lower()}') else text end"
    return f"""
        with leaves as (select doc_id, lang, {leaf('text')} as h, {leaf(lower)} as claim from documents),
        numbered as (select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by lang) as n from leaves),
        {tree('t', 'lang', 'select lang, n, pos, h from numbered', levels)},
        langs as (select lang, h, 0 as forest, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from ttop),
        {tree('r', 'forest', 'select forest, n, pos, h from langs', top_levels)},
        started as (select numbered.*, langs.h as subroot, langs.pos as place, 0 as forest, claim as f, '' as s from numbered join langs on numbered.lang is not distinct from langs.lang),
        {climbed('started', 't', 'lang', 'pos', levels, 'low')},
        {climbed('low', 'r', 'forest', 'place', top_levels, 'high')}
        select doc_id, high.h as leaf, subroot, rtop.h as root, sha256(s) as proof_sha256, f as folded_root, f = rtop.h as verified, strlen(s) // 64 as n_siblings
        from high, rtop"""


#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": f"""
        with items as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
        windows as (select distinct item_id, least(13, len(w)) as k, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') as gram
                    from items, unnest(range(1, len(w) - least(13, len(w)) + 2)) as t(p) where len(w) > 0),
        docs as (select doc_id, {_WORDS} as w from documents),
        grams as (select doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') as gram
                  from docs, (select distinct k from windows) as sizes, unnest(range(1, len(w) - k + 2)) as t(p)),
        hits as (select doc_id, item_id, k, p from grams join windows using (k, gram)),
        covered as (select doc_id, count(distinct p + o) as n_hit from hits, unnest(range(0, k)) as t(o) group by doc_id),
        owners as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as names from hits group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from docs left join covered using (doc_id) left join owners using (doc_id)""",
    "near_benchmark_items": f"""
        with items as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
        docs as (select doc_id, {_WORDS} as w from documents),
        sets as (select row_number() over () as s, item_id, list_distinct(w) as w from items where len(w) > 0),
        members as (select s, item_id, len(w) as n, unnest(w) as word from sets),
        placed as (select doc_id, p, w[p] as word from docs, unnest(range(1, len(w) + 1)) as t(p)),
        held as (select distinct doc_id, word from placed),
        whole as (select doc_id, s, item_id, n from held join members using (word) group by all having count(*) = n),
        spots as (select doc_id, s, item_id, n, p, word from whole join members using (s, item_id, n) join placed using (doc_id, word)),
        close_ as (select a.doc_id, a.item_id from spots a join spots b on a.doc_id = b.doc_id and a.s = b.s and b.p >= a.p and b.p < a.p + a.n + 20
                   group by a.doc_id, a.s, a.item_id, a.n, a.p having count(distinct b.word) = a.n)
        select distinct doc_id, item_id from close_""",
    "op7_suffix_array_dedup": r"""
        with docs as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents),
        grams as (select doc_id, p, array_to_string(w[p : p + 50], ' ') as gram from docs, unnest(range(1, len(w) - 49)) as t(p)),
        shared as (select gram from grams group by gram having count(distinct doc_id) > 1),
        covered as (select distinct doc_id, p + o as place from grams join shared using (gram), unnest(range(0, 51)) as t(o)),
        runs as (select doc_id, place, place - row_number() over (partition by doc_id order by place) as run from covered)
        select doc_id, min(place) - 1 as start_word, max(place) as end_word, count(*) as n_words from runs group by doc_id, run""",
    "op11_ranked_search": rf"""
        with docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
        size as (select count_if(len(w) > 0)::bigint as held, sum(len(w))::bigint as total from docs),
        asked as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark where item_id is not null),
        postings as (select r, doc_id, n, term, count(*)::bigint as tf from (select r, doc_id, len(w)::bigint as n, unnest(w) as term from docs)
                     where term in (select term from asked) group by all),
        weights as (select term, floor(1000 * ln((2 * held + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from postings, size group by term, held),
        scored as (select item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * held) // total))))::bigint as score
                   from asked join postings using (term) join weights using (term), size group by item_id, r, doc_id)
        select item_id, (row_number() over (partition by item_id order by score desc, doc_id nulls last))::int as rank, doc_id, score from scored where score > 0
        qualify rank <= 10""",
    "op12_minhash_near_dup": rf"""
        with recursive words as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') as w from documents),
        sets as (select r, doc_id, case when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from words),
        members as (select r, len(s) as n, unnest(s) as g from sets),
        links as (select a.r as a, b.r as b from members a join members b on a.g = b.g and a.r <> b.r and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
                  group by a.r, b.r, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach as (select r as a, r as b from sets union select reach.a, links.b from reach join links on reach.b = links.a)
        select doc_id, len(s)::bigint as n_shingles, component_id, doc_id is not distinct from component_id as kept
        from sets join (select a, min(t.doc_id) as component_id from reach join sets t on t.r = reach.b group by a) on a = r""",
    "op13_merkle_manifest": _merkle_sql(),
}
