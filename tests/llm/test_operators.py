import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import LOWER, WORD, components, fingerprint, measures, mix_targets, repeats, sha
from pyspark.sql import functions as F

from peakloom.llm import exact_dedup, mixing, packing, quality_classifier, quality_rules, registry, sharding, simhash, substrings, warc
from peakloom.session import materialize

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 8))) for _ in range(n))


def odd_rows():
    shared = words(90, 1)
    long_text = words(9000, 2)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "Same Text É", "en", "a", 3), (5, "same text É", None, None, 3),
        (6, "same text é", "en", "b", 3), (7, "x", "en", "b", 1), (7, "x", "en", "b", 1), (None, "x", "en", "b", 1), (None, None, "en", "b", 1),
        (8, long_text, "en", "a", 1), (9, long_text + " end", "en", "c", 1), (10, words(50, 3) + shared + words(40, 4), "en", "c", 1),
        (11, shared + " " + words(9, 5) + " " + shared, "en", "a", 1), (12, "ab " * 700, "en", "a", 1), (13, "\n".join([words(12, 6)] * 5), "en", "b", 1), (14, "one two", "en", "d", 1),
        (15, "a\x1cb c\u0085d", "en", "d", 1),
    ]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


def clashing(df):
    """With extra columns that bear the names of results and helpers."""
    names = ["kept", "KEEP_ID", "size", "taken", "position", "target", "runs", "fp", "n_words", "host_ok", "rank", "group", "slot", "ids", "score", "maybe", "group_size", "base_failed"]
    return df.withColumns({n: F.lit("extra") for n in names})


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_exact_dedup(spark, odd):
    found = rows_of(exact_dedup.mark_duplicates(clashing(odd)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = defaultdict(list)
    for r in odd_rows():
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    want = []
    for r in odd_rows():
        g = groups[(r[1] or "").translate(LOWER)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((r[0], keep, len(g), r[0] == keep, sha((r[1] or "").translate(LOWER).encode())))
    assert found == sorted(want, key=repr)
    kept = exact_dedup.drop_duplicates(clashing(odd))
    assert kept.columns == clashing(odd).columns
    assert rows_of(kept, "doc_id", "text", "kept") == sorted(((w[0], r[1], "extra") for w, r in zip(want, odd_rows()) if w[3]), key=repr)
    assert exact_dedup.drop_duplicates(odd.limit(0)).count() == 0


def test_full_bloom_filter_changes_nothing(spark):
    texts = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 2000).alias("text"))
    marked = exact_dedup.mark_duplicates(texts, max_words=8)
    assert marked.where("kept").count() == 2000 and marked.agg(F.sum("group_size")).first()[0] == 1000 * 2 * 2 + 1000


def test_bloom_keeps_singles_off_the_shuffle(spark):
    hashed = spark.range(20000).select(F.sha2(F.when(F.col("id") < 19990, F.col("id")).otherwise(F.lit(5)).cast("string"), 256).alias("text_sha256"))
    word, mask = exact_dedup.bloom_cell(F.col("text_sha256"), 16384)
    bits = exact_dedup.repeated_bits(hashed.select(word.alias(exact_dedup.WORD), mask.alias(exact_dedup.MASK)))
    hit = hashed.withColumns({exact_dedup.WORD: word, exact_dedup.MASK: mask}).join(bits, exact_dedup.WORD).where(f"(__bits & {exact_dedup.MASK}) = {exact_dedup.MASK}")
    assert 11 <= hit.count() < 200


def test_mix(spark, odd, real):
    for docs in (clashing(odd), real):
        plan = mixing.mix_plan(docs).collect()
        rows = docs.select("doc_id", "text", "source").collect()
        sizes = Counter()
        for r in rows:
            sizes[r.source] += len(WORD.findall(r.text or ""))
        want = mix_targets(dict(sizes))
        assert sorted((r.doc_id, r["size"]) for r in plan if r.doc_id) == sorted((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows if r.doc_id)
        assert all(0 <= r.taken <= 2 * r["size"] for r in plan)
        found = Counter()
        for r in plan:
            found[(r.source_size, r.target)] += r.taken
        assert sorted(t for _, t in found) == pytest.approx(sorted({(sizes[s], round(want[s], 6)): want[s] for s in want}.values()))
        for (size, target), taken in found.items():
            same = sum((sizes[s], round(want[s], 6)) == (size, target) for s in want)
            assert abs(taken - same * target) <= same
        positions = [r.position for r in plan if r.position is not None]
        assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
        assert sorted(map(tuple, plan), key=repr) == sorted(map(tuple, mixing.mix_plan(docs.repartition(5)).collect()), key=repr)
    assert mixing.mix_plan(odd.limit(0)).count() == 0


def test_mixed_documents(spark, real, odd):
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix_plan(real).collect()}
    copies = Counter(r.doc_id for r in mixing.mixed_documents(clashing(real)).collect())
    assert copies == {d: int(t / max(1, n) + 0.5) for d, (t, n) in taken.items() if int(t / max(1, n) + 0.5)}
    assert mixing.mixed_documents(clashing(odd)).columns == clashing(odd).columns


def test_schedule_inversion(spark):
    at = spark.range(0, 101).select((F.col("id") / 100).alias("u"), *[mixing.invert(F.col("id") / 100, F.lit(k)).alias(f"t{k}") for k in range(3)]).collect()
    for k, knots in enumerate(mixing.SCHEDULES):
        grid = np.linspace(0, 1, 20001)
        weight = np.interp(grid, np.linspace(0, 1, len(knots)), knots)
        done = np.r_[0, np.cumsum((weight[1:] + weight[:-1]) / 2)]
        for r in at:
            assert np.interp(r[f"t{k}"], grid, done / done[-1]) == pytest.approx(r.u, abs=1e-6)


@pytest.mark.parametrize("table", ["odd", "real"])
def test_quality_rules(spark, odd, real, table):
    docs = clashing(odd) if table == "odd" else real
    found = quality_rules.rule_verdicts(docs)
    names = ["doc_id", *quality_rules.MEASURES, "base_failed"]
    want = []
    for r in docs.select("doc_id", "text").collect():
        m = measures(r.text)
        want.append((r.doc_id, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert rows_of(found, *names) == sorted(want, key=repr)
    kept = quality_rules.passing_documents(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == rows_of(found.where("kept"), "doc_id")


def test_host_verdict(spark):
    good, bad = words(60, 7), "# | # | " * 40
    rows = [(i, good, None, f"g{i % 5}", 1) for i in range(100)] + [(200 + i, words(30, i) + " ### " * 40, None, "junk", 1) for i in range(40)] + [(400, words(30, 9) + " ### " * 40, None, "tiny", 1), (401, bad, None, None, 1)]
    found = quality_rules.rule_verdicts(spark.createDataFrame(rows, DOCS)).collect()
    kept = {r.doc_id: r.kept for r in found}
    assert all(kept[i] for i in range(100)) and not any(kept[200 + i] for i in range(40))
    rates = {r.doc_id: r.host_rate for r in found}
    assert rates[400] < 1.0 and rates[401] is None


@pytest.mark.parametrize("width", [400, 160])
def test_repeats_odd(spark, odd, width):
    found = rows_of(substrings.digest_repeats(substrings.remove_repeats(clashing(odd), width)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = [(r[0], *x) for r, x in zip(odd_rows(), repeats([r[1] for r in odd_rows()], width))]
    assert found == sorted(want, key=repr)
    assert sum(x[2] for x in found) > 0


def test_repeats_real(spark, real):
    docs = real.orderBy("doc_id").limit(120)
    rows = docs.collect()
    found = rows_of(substrings.digest_repeats(substrings.remove_repeats(docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == sorted(((r.doc_id, *x) for r, x in zip(rows, repeats([r.text for r in rows], 400))), key=repr)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_repeats_planted(spark):
    """Passages at every offset, with edits, and periodic texts."""
    r = random.Random(5)
    letters = "abcdefgh "
    noise = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [noise(n) for n in (399, 400, 401, 431, 432, 433, 700, 1500)]
    texts = []
    for i in range(60):
        p = r.choice(passages)
        cut = r.randrange(len(p))
        texts.append(noise(r.randrange(300)) + (p if i % 3 else p[:cut] + "#" + p[cut + 1 :]) + noise(r.randrange(300)))
    texts += ["ab" * 500, "ab" * 450, "z" * 2000, "é" * 450]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rows_of(substrings.digest_repeats(substrings.remove_repeats(docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == sorted(((i, *x) for i, x in enumerate(repeats(texts, 400))), key=repr)


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 1000)
    text = words(2000, 11).encode()
    blocks = [b for x in substrings.anchored_blocks(text) for b in zip(x["lo"].tolist(), x["hi"].tolist(), x["at"].tolist())]
    starts = [i for lo, hi, at in blocks for i in range(lo, hi + 1) if lo <= at and at + substrings.GRAM <= lo + 400]
    assert sorted(starts) == list(range(len(text) - 399))


@pytest.mark.parametrize("table", ["odd", "real"])
def test_shards(spark, odd, real, table):
    docs = clashing(odd) if table == "odd" else real
    found = sharding.shard_documents(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in found), key=repr) == want
    load, places = Counter({s: 0 for s in range(24)}), defaultdict(list)
    for r in found:
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(24))
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in found)
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def test_rebalance_moves_little(spark, real, tmp_path):
    rows = materialize(sharding.records(real, slots=256), "t")
    sizes = sharding.slot_bytes(rows)
    first = materialize(sharding.rebalance(sizes, 4), "t")
    second = materialize(sharding.rebalance(sizes, 5, first, 1), "t")
    sharding.save_map(first, str(tmp_path / "map"))
    sharding.save_map(second, str(tmp_path / "map"))
    assert spark.read.parquet(str(tmp_path / "map")).groupBy("version").count().count() == 2
    a, b = ({r.virtual_slot: r.shard for r in m.collect()} for m in (first, second))
    assert a.keys() == b.keys() and 0 < sum(a[s] != b[s] for s in a) < len(a) * 0.45
    loads = Counter()
    for r in sizes.collect():
        loads[b[r.virtual_slot]] += r.slot_size
    assert max(loads.values()) < 1.3 * min(loads.values())


@pytest.mark.parametrize("table,hot", [("odd", 4096), ("real", 4096), ("real", 2)])
def test_simhash(spark, odd, real, table, hot):
    docs = clashing(odd) if table == "odd" else real
    rows = docs.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    want = [(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, components([r.doc_id for r in rows], prints))]
    assert rows_of(simhash.near_duplicates(docs, hot=hot), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    kept = simhash.drop_near_duplicates(docs, hot=hot)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == sorted(((w[0],) for w in want if w[0] is None or w[0] == w[2]), key=repr)


def test_simhash_empty(spark, odd):
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n,bits", [(3000, 24), (700, 9)])
def test_gray_index_against_all_pairs(n, bits):
    rng = np.random.default_rng(n)
    value = np.unique(sum(rng.integers(0, 2, n).astype(np.uint64) << np.uint64(k * 64 // bits) for k in range(bits)))
    a, b = simhash.link_buckets(np.zeros(len(value), np.int64), value)
    label = {int(v): int(v) for v in value}
    near = np.bitwise_count(value[:, None] ^ value[None, :]) <= 3
    want = components(list(range(len(value))), [int(v) for v in value])
    assert near.sum() > len(value)
    for x, y in zip(a.tolist(), b.tolist()):
        label[x] = y
    groups = {}
    for v, c in zip(value.tolist(), want):
        groups.setdefault(c, set()).add(label[int(v)])
    assert all(len(g) == 1 for g in groups.values()) and len(set(label.values())) == len(groups)


@pytest.mark.parametrize("table", ["odd", "real"])
def test_packing(spark, odd, real, table):
    from tokenizers import Tokenizer

    docs = (clashing(odd) if table == "odd" else real).withColumn("text", F.when(F.col("doc_id") == 14, F.lit("one<|endoftext|>two <|startoftext|> it's ΣΑΣ  1,234 don't")).otherwise(F.col("text")))
    pieces = packing.pack_documents(docs, registry.public_vocabulary(), group_sequences=8).collect()
    tokenizer = Tokenizer.from_file(registry.public_vocabulary())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    spans, filled = defaultdict(list), defaultdict(list)
    for p in pieces:
        spans[(p.doc_id, p.doc_tokens)].append((p.start, p.length, p.ids_crc32))
        filled[p.sequence_id].append((p.offset, p.length))
    for s in filled.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:])) and min(s)[0] == 0 and sum(n for _, n in s) <= 4096
    for (d, n), ps in spans.items():
        copies = sum(c for k, c in want.items() if k[:2] == (d, n))
        cover = Counter()
        for start, length, _ in ps:
            cover.update(range(start, start + length))
        assert len(cover) == n and set(cover.values()) == {copies}
    whole_ones = {(d, n, p[2]) for (d, n), ps in spans.items() for p in ps if p[1] == n}
    assert whole_ones <= set(want) and whole_ones
    total, held = sum(k[1] * c for k, c in want.items()), len(filled) * 4096
    assert held - total < 4096 * max(1, round(total / (4096 * 8)))
    assert packing.pack_documents(odd.limit(0), registry.public_vocabulary()).count() == 0


def test_pack_costs_are_even():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 3000, 2000)
    pieces = packing.pack(lengths)
    cost = Counter()
    for _, _, n, s in pieces:
        cost[s] += n + n * n / 2048
    values = np.array(sorted(cost.values())[1:])
    assert values.std() / values.mean() < 0.25


def test_warc(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "u", "x" * 300000), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "v", "<p>é</p>"), (None, "u", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit("extra"), "refers_to": F.lit(1), "payload": F.lit(2)})
    found = rows_of(warc.archive_pages(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and i > first[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert found == sorted(want, key=repr)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_real(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r.page_id].payload_digest == warc.digest(r.html.encode()) and found[r.page_id].payload_bytes == len(r.html.encode())


def test_archive_starts_with_its_dictionary():
    records = [warc.format_record(i, "u", words(60, i).encode(), "d", None, False) for i in range(300)]
    data = warc.format_archive(records)
    assert data[:4] == b"\x50\x2a\x4d\x18" or int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    assert list(warc.iterate_archive(data)) == records


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_classifier.classify(docs, labels)
    told = scored.where("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert scored.count() == docs.count() and len(told) > 500
    assert sum(r.quality == r.predicted for r in told) / len(told) > 0.97


def test_quality_classifier_odd(spark, odd):
    labels = spark.createDataFrame([(8, 1, 0), (12, 0, 0), (8, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    scored = quality_classifier.classify(clashing(odd), labels)
    assert scored.count() == len(odd_rows()) and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    alone = quality_classifier.classify(odd, labels.limit(0)).select("score").distinct().collect()
    assert len(alone) == 1
    assert quality_classifier.classify(odd.limit(0), labels).count() == 0


def test_stored_map_is_edited(spark, real, tmp_path):
    path = f"file://{tmp_path}/map"
    first = {r.virtual_slot: r.shard for r in sharding.shard_documents(real, 4, 256, map_path=path).collect()}
    again = sharding.shard_documents(real.where("doc_id % 5 != 0"), 4, 256, map_path=path).collect()
    assert {r.map_version for r in again} == {1} and sharding.load_map(spark, path).agg(F.max("version")).first()[0] == 1
    moved = {r.virtual_slot for r in again if first[r.virtual_slot] != r.shard}
    assert len(moved) < 0.4 * len(first)


def test_polarised_hosts(spark):
    rows = [(f"{h}{k}", 50, 50) for h in ("bad",) for k in range(5)] + [(f"good{k}", 50, 0) for k in range(5)] + [("large", 3000, 0)]
    made = spark.createDataFrame(rows, "host string, n int, fails int").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    fails = F.col("i") <= F.col("fails")
    measured = made.select("host", F.when(fails, 5).otherwise(100).cast("long").alias("n_words"), F.lit(500).cast("long").alias("word_chars"), *[F.lit(0).cast("long").alias(c) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")])
    found = {r["__host"]: r for r in quality_rules.host_verdicts(measured.withColumn("word_chars", F.col("n_words") * 5), "host").collect()}
    assert all(found[f"bad{k}"].host_rate > 0.9 and not found[f"bad{k}"].host_ok for k in range(5))
    assert all(r.host_ok and r.host_rate < 0.1 for h, r in found.items() if not h.startswith("bad"))
    one = measured.withColumn("host", F.monotonically_increasing_id().cast("string"))
    assert quality_rules.host_verdicts(one, "host").where("host_rate IS NULL").count() == 0


def test_repeated_id_with_another_text_stays(spark):
    a, b = words(80, 21), words(80, 22)
    docs = spark.createDataFrame([(3, a), (7, a), (7, b), (9, b + " x"), (9, b + " x")], "doc_id long, text string")
    for keep in (simhash.drop_near_duplicates(docs), simhash.drop_similar(docs)):
        assert rows_of(keep, "doc_id", "text") == sorted([(3, a), (7, b)], key=repr)


def test_archive_sample_reaches_every_part():
    records = [bytes([65 + i % 26]) * 40_000 for i in range(200)]
    pieces = warc.sample_pieces(records)
    assert sum(map(len, pieces)) <= warc.SAMPLE_BYTES + warc.PIECE and {p[:1] for p in pieces} == {bytes([65 + k]) for k in range(26)}
    assert b"".join(warc.sample_pieces([b"abc", b"", b"de"])) == b"abcde"


def test_periodic_text_makes_few_rows(spark):
    texts = ["z" * (3 << 20), "xy" * 800_000 + "".join(random.Random(3).choices("abcdefghij ", k=900)), "plain text " + "".join(random.Random(4).choices("abcdefghij ", k=900))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = substrings.keyed(docs, "doc_id", "text")
    assert substrings.block_table(rows).count() < 200
    found = {r.doc_id: r for r in substrings.digest_repeats(substrings.remove_repeats(docs)).collect()}
    assert [found[i].n_removed for i in range(3)] == [3 << 20, 1_600_000, 0]


def test_repeats_in_copies_of_a_row(spark):
    text = words(200, 31)
    docs = spark.createDataFrame([(1, text)] * 40 + [(2, words(200, 32))], "doc_id long, text string")
    found = Counter(tuple(r) for r in substrings.digest_repeats(substrings.remove_repeats(docs)).select("doc_id", "n_removed", "n_spans").collect())
    assert found == {(1, len(text.encode()), 1): 40, (2, 0, 0): 1}


@pytest.mark.parametrize("filter_words", [64, 1 << 20])
def test_shared_passages(spark, real, filter_words):
    passage = words(51, 41).split()
    rows = [(1, words(70, 42) + " " + " ".join(passage)), (2, "\n".join(passage) + "\n" + words(30, 43)), (3, " ".join(passage[:50]) + " x " + words(60, 44)), (4, (words(60, 45) + " ") * 3), (5, None), (6, ""), (None, " ".join(passage))]
    rows += [(r.doc_id + 10, r.text) for r in real.orderBy("doc_id").limit(80).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    owners = defaultdict(set)
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 50):
            owners[tuple(w[k : k + 51])].add(i)
    want = {i for s in owners.values() if len(s) > 1 for i in s}
    keyed = substrings.keyed(docs, "doc_id", "text")
    found = keyed.join(substrings.shared_passages(keyed, words=filter_words), ["k1", "k2"]).select("doc_id").collect()
    assert sorted((r.doc_id for r in found), key=repr) == sorted(want, key=repr) and {1, 2, None} <= want and not {3, 4} & want
    digested = substrings.digest_repeats(substrings.remove_repeats(docs), substrings.shared_passages(keyed))
    assert digested.count() == len(rows) and {r.doc_id for r in digested.where("shares_passage").collect()} == want
