"""Decontamination, SimHash and repeated passages against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from foliant.llm import decontaminate, graph, simhash, suffixes
from foliant.llm.queries import QUERIES
from foliant.llm.rules import kept_documents

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items, window=13, share=20):
    found, out = {}, []
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found.setdefault(tuple(w[k : k + n]), set()).add(item)
    for doc_id, text in docs:
        w, hit, owners = words(text), set(), set()
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                if owner := found.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    owners |= owner
        digest = hashlib.sha256(",".join(sorted(map(str, owners))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(owners), digest, bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=repr)


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_contamination_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert collected(QUERIES["op1_benchmark_decontamination"](spark, sf_dir)) == brute_contamination(docs, items)


def test_contamination_small_alphabet(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)]
    items = [(1, text(4)), (2, text(6)), (2, text(2)), (10, text(3)), (7, ""), (8, None), (None, "a b")]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    wanted = brute_contamination(docs, [x for x in items if x[0] is not None], window=3)
    assert collected(decontaminate.contamination(*frames, window=3)) == wanted
    # small index blocks, and a benchmark read in several blocks, change nothing
    assert collected(decontaminate.contamination(*frames, window=3, block_words=30, query_words=5)) == wanted


def test_contamination_odd_rows(spark, odd_rows, no_rows):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, None)], "item_id long, text string")
    rows = [tuple(r) for r in odd_rows.select("doc_id", "text").collect()]
    assert collected(decontaminate.contamination(odd_rows, items)) == brute_contamination(rows, [(1, "alpha beta gamma")])
    assert decontaminate.contamination(no_rows, items).count() == 0
    assert decontaminate.contamination(odd_rows, items.limit(0)).where("contaminated or n_hit > 0").count() == 0
    kept = decontaminate.clean_documents(odd_rows, items)
    assert kept.columns == odd_rows.columns and kept.count() == odd_rows.count() - 2


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x one y y two z"), (2, "one " + "y " * 30 + "two"), (3, "two one"), (4, "one")], "doc_id long, text string")
    index = decontaminate.build_index(docs)
    items = spark.createDataFrame([(9, "one two")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.proximity_matches(index, items, 5).collect()} == {1, 3}


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes):
    values = np.array(sorted(set(codes.values())), np.uint64)
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3):
            parent[root(i + 1 + int(j))] = root(i)
    group = {int(v): root(i) for i, v in enumerate(values)}
    least = {}
    for doc, code in codes.items():
        least[group[code]] = min(doc, least.get(group[code], doc))
    return {doc: least[group[code]] for doc, code in codes.items()}


def test_near_duplicates_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    codes = {k: plain_simhash(t) for k, t in texts.items()}
    component = brute_components(codes)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash_near_dup"](spark, sf_dir).collect()}
    assert found == {k: (f"{codes[k]:016x}", component[k]) for k in texts}


def test_links_lose_nothing(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = {c for c in centres} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for c in centres for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    wanted = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    for hot in (2000, 5):  # with a small hot_bucket every bucket goes the refined way
        assert {tuple(r) for r in simhash.near_links(frame, 3, hot).collect()} == wanted


def test_thresholds_spend_the_distance():
    together = np.full((64, 64), 250.0)
    np.fill_diagonal(together, 500.0)
    for m in (2, 3, 4):
        parts = simhash.group_bits(together, 1000, m)
        assert sorted(b for p in parts for b in p.bits) == list(range(64))
        _, planned = simhash.allot(parts, [10.0] * m, together, 1000, 3)
        assert sum(p.threshold + 1 for p in planned) == 4


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = {r["node"]: r["label"] for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_near_duplicates_odd_rows(odd_rows, no_rows):
    found = simhash.near_duplicates(odd_rows)
    assert found.count() == odd_rows.count() and simhash.near_duplicates(no_rows).count() == 0
    empty = {r["doc_id"]: r["component_id"] for r in found.where("fingerprint = '0000000000000000'").collect()}
    assert empty == {2: 2, 3: 2, 5: 2}
    kept = simhash.without_near_duplicates(odd_rows)
    assert kept.columns == odd_rows.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 4, 6]


def brute_passages(docs, n=51):
    held = collections.defaultdict(set)
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - n + 1):
            held[tuple(w[k : k + n])].add(i)
    out = set()
    for i, w in split:
        covered = sorted({p for k in range(len(w) - n + 1) if len(held[tuple(w[k : k + n])]) > 1 for p in range(k, k + n)})
        for p in covered:
            if p - 1 not in covered:
                start = p
            if p + 1 not in covered:
                out.add((i, start, p + 1))
    return out


def test_passages_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op7_suffix_array_dedup"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in found} == brute_passages(docs)


def test_passages_small_words(spark):
    rng = random.Random(5)
    piece = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    shared = [piece(n) for n in (12, 14, 30)]
    docs = [(i, " ".join(piece(rng.randint(0, 15)) + rng.choice(shared)[rng.randint(0, 3) :] + piece(rng.randint(0, 15)))) for i in range(40)] + [(99, "z " * 60), (98, "z " * 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = suffixes.passages(frame, min_words=10, head=4).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in found} == brute_passages(docs, 10)
    cut = [tuple(r) for r in suffixes.without_repeats(frame, 10, 4).collect()]
    assert len(cut) == len(docs) and not brute_passages_across(cut, docs)


def brute_passages_across(cut, docs, n=10):
    """Windows of the cut texts that two documents hold although neither cut made them."""
    was = {(i, tuple(t.split()[k : k + n])) for i, t in docs for k in range(len(t.split()) - n + 1)}
    held = collections.Counter(x for i, t in cut for x in {tuple(t.split()[k : k + n]) for k in range(len(t.split()) - n + 1)} if (i, x) in was)
    return [x for x, c in held.items() if c > 1]


def test_passages_odd_rows(odd_rows, no_rows):
    assert suffixes.passages(odd_rows).count() == 0 == suffixes.passages(no_rows).count()
    assert suffixes.without_repeats(odd_rows).count() == odd_rows.count()
    twice = odd_rows.where("doc_id = 4").unionByName(odd_rows.where("doc_id = 4").withColumn("doc_id", F.lit(8).cast("long")))
    assert [(r["n_words"], r["n_removed"]) for r in suffixes.passages(twice).orderBy("n_removed").collect()] == [(30_000, 0), (30_000, 30_000)]
    assert suffixes.drop_words("a b  c\nd e", [(1, 3)]) == "a\nd e"


def test_queries_equal_sql(spark, sf_dir):
    import duckdb

    from foliant.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        found, wanted = QUERIES[name](spark, sf_dir).toPandas(), con.sql(sql).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert sorted(found[sorted(found)].itertuples(index=False, name=None)) == sorted(wanted[sorted(found)].itertuples(index=False, name=None))


def test_near_copies_without_ids_leave_one(spark):
    one, two = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows = spark.createDataFrame([(None, one), (None, one), (None, two), (None, two.upper()), (7, "x y z " * 9)], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"].lower()) for r in simhash.without_near_duplicates(rows).collect()]
    assert sorted(kept, key=repr) == sorted([(None, one), (None, two), (7, "x y z " * 9)], key=repr)


def brute_near(docs, items, slack):
    out = set()
    for doc, text in docs:
        w = words(text)
        for item, wanted in items:
            need = set(words(wanted))
            if need and any(need <= set(w[k : k + len(need) + slack]) for k in range(len(w))):
                out.add((doc, item))
    return out


def test_near_items_equal_brute_force(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)] + [(900, None), (901, "")]
    items = [(i, text(rng.randint(1, 9))) for i in range(25)] + [(77, None), (78, "zzz")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = decontaminate.build_index(frame, block_words=200)
    for slack in (0, 1, 4):
        found = decontaminate.proximity_matches(index, spark.createDataFrame(items, "item_id long, text string"), slack)
        assert {tuple(r) for r in found.collect()} == brute_near(docs, items, slack)


def test_near_duplicates_keep_unlike_texts_of_an_id(spark):
    one, two = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, one, "a"), (1, two, "b"), (1, two, "b"), (2, one, "c"), (3, two + " end", "d"), (None, one, "e"), (4, None, "f"), (5, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    kept = simhash.without_near_duplicates(docs, one_text_per_id=False)
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    expected = [(1, one), (1, two), (4, None)]
    if not any((r["doc_id"], r["text"]) == (3, two + " end") for r in kept.collect()):
        assert found == sorted(expected, key=repr)
    else:  # one more word may flip more than three bits
        assert found == sorted([*expected, (3, two + " end")], key=repr)
    assert kept.columns == docs.columns
    assert simhash.without_near_duplicates(docs.limit(0), one_text_per_id=False).count() == 0


def test_stages_take_any_column_names(spark):
    names = ["__row", "__removed", "__n", "__kept", "fp", "row", "key", "key_id", "key_text", "of_doc_id", "judged", "fingerprint"]
    rows = [(i, f"text number {i} with words of its own " * 4, *range(len(names))) for i in range(4)] + [(None, None, *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    items = spark.createDataFrame([(1, "text number 2 with words of its own")], "item_id long, text string")
    for stage in (lambda d: simhash.without_near_duplicates(d, one_text_per_id=False), simhash.without_near_duplicates, suffixes.without_repeats, lambda d: decontaminate.clean_documents(d, items), lambda d: kept_documents(d, 0.0)):
        found = stage(docs)
        assert found.columns == docs.columns
        assert all(tuple(r)[2:] == tuple(range(len(names))) for r in found.collect())


def test_clean_documents_with_repeated_and_null_ids(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "nothing here"), (None, "Alpha beta, gamma delta!"), (None, "other"), (2, None), (2, "")], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in decontaminate.clean_documents(docs, items).collect()]
    assert sorted(kept, key=repr) == sorted([(1, "nothing here"), (None, "other"), (2, None), (2, "")], key=repr)


def brute_cut(docs, n):
    """Windows that another document keeps: for each document its words in such windows, by the least `row` of the holders."""
    rows = {i: r for i, r in docs[1].items()}
    held = collections.defaultdict(set)
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in docs[0]}
    for i, w in split.items():
        for k in range(len(w) - n + 1):
            held[tuple(w[k : k + n])].add(i)
    return {i: sorted({p for k in range(len(w) - n + 1) if min(held[tuple(w[k : k + n])], key=rows.get) != i for p in range(k, k + n)}) for i, w in split.items()}


def test_suffixes_of_hot_and_cool_heads_agree_with_brute_force(spark):
    rng = random.Random(21)
    piece = lambda n: [rng.choice("abcdef") for _ in range(n)]
    source = piece(120)
    docs = []
    for i in range(70):
        a, b = sorted((rng.randint(0, 120), rng.randint(0, 120)))
        docs.append((i, " ".join(piece(rng.randint(0, 9)) + source[a:b] + piece(rng.randint(0, 9)) + source[b // 2 : b // 2 + 12] * rng.choice([0, 1, 3]))))
    docs += [(200, "z " * 90), (201, "z " * 70 + "y"), (202, "y " + "z " * 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for hot in (1000, 1, 8):  # every head brought together, none, and some
        found = suffixes.repeated_passages(frame, 10, 4, hot).collect()
        spans = {(r["doc_id"], x["start"], x["stop"]) for r in found for x in r["spans"]}
        assert spans == brute_passages(docs, 10)
        wanted = brute_cut((docs, {r["doc_id"]: r["row"] for r in found} | {i: 1 << 70 for i, _ in docs if i not in {r["doc_id"] for r in found}}), 10)
        assert {r["doc_id"]: [p for x in r["removed"] for p in range(x["start"], x["stop"])] for r in found} == {r["doc_id"]: wanted[r["doc_id"]] for r in found}


def test_heads_at_many_places(spark):
    """A passage that few documents repeat at many places each is found without bringing its places together, by hashes, and alike."""
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(60)]
    filler = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    docs = []
    for i in range(6):
        words = filler(30)
        for _ in range(8):
            words += shared + filler(rng.randint(3, 9))
        docs.append((i, " ".join(words)))
    docs += [(10 + i, " ".join(filler(80))) for i in range(4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = [sorted((r["doc_id"], r["spans"], r["removed"]) for r in suffixes.repeated_passages(frame, hot_places=n).select("doc_id", "spans", "removed").collect()) for n in (5, 20_000)]
    assert found[0] == found[1] and len(found[0]) == 6 and all(len(spans) == 8 for _, spans, _ in found[0])


def test_rows_joined_with_long_values(spark, monkeypatch):
    """What is joined to rows is broadcast only within a bound of bytes; the result is the same beyond it."""
    from foliant.llm import common

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(None, "none")], "doc_id long, text string")
    keys = docs.where("doc_id % 2 = 0 or doc_id is null").select("doc_id", common.text_hash().alias("text_hash"), F.array_repeat(F.lit("x"), 100).alias("removed"))
    results = []
    for bound in (32_000_000, 10):
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
        joined = common.joined_rows(docs, keys, "inner")
        results.append((sorted(map(str, joined.collect())), "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()))
    assert results[0][0] == results[1][0] and len(results[0][0]) == 26 and results[0][1]


def test_index_row_groups_follow_blocks(spark, monkeypatch):
    """Before, Parquet's writer looked at its size every 100 rows only, so a task held all blocks of its input, to write as to read them."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 100_000)
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(4000))) for i in range(40)]
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), block_words=4000)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    sizes = [(m.row_group(i).num_rows, m.row_group(i).total_byte_size) for m in groups for i in range(m.num_row_groups)]
    assert sum(n for n, _ in sizes) == index.count() == 40
    assert max(n for n, _ in sizes) <= 5 and max(size for _, size in sizes) <= 3 * 100_000
