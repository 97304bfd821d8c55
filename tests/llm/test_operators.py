"""Every operator against its plain version, with odd rows, and on empty tables."""

import itertools
import random
import zlib

import plain
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidence_engine.llm import (
    decontamination,
    language_model,
    line_chunks,
    lsh_forest,
    packing,
    quality,
    secrets,
    suffix_dedup,
    url_filters,
    warc,
)
from evidence_engine.llm.components import components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def digest(df):
    return ordered(
        df.select(
            "doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256)
        ).collect()
    )


def test_suffix_dedup(docs, rows, odd, empty):
    assert digest(suffix_dedup.remove_repeats(docs)) == ordered(plain.suffix_dedup(pairs(rows)))
    assert digest(suffix_dedup.remove_repeats(odd[0])) == ordered(plain.suffix_dedup(odd[1]))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffixes_of_blocks(monkeypatch):
    """Texts longer than a block, periodic ones too: every window is in one run, each run's windows hold its suffix."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    r = random.Random(3)
    for text in (bytes(r.choices(range(97, 105), k=1000)), b"ab" * 300, b"x" * 777):
        first, last, place, _ = suffix_dedup.anchors(np.frombuffer(text, np.uint8), 200)
        assert [i for s, e in zip(first, last) for i in range(s, e + 1)] == list(range(len(text) - 199))
        assert all(e <= p <= s + 200 - suffix_dedup.GRAM for s, e, p in zip(first, last, place))


def shown(df):
    return ordered(df.select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, words, percent):
    assert shown(lsh_forest.near_duplicates(docs, words, percent)) == ordered(
        plain.near_duplicates(pairs(rows), words, percent)
    )


def test_near_duplicates_with_equal_signatures(spark):
    """Many neighbours are equally alike: whichever is verified first, no link is lost."""
    r = random.Random(17)
    rows = []
    for group in range(12):
        base = [f"w{group}x{i}" for i in range(60)]
        for _ in range(25):
            changed = list(base)
            for at in r.sample(range(60), 2):
                changed[at] = f"other{r.randrange(4)}"
            rows.append((len(rows), " ".join(changed)))
    expected = ordered(plain.near_duplicates(rows, 3, 85))
    for parts in (1, 3, 8):
        r.shuffle(rows)
        dealt = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert shown(lsh_forest.near_duplicates(dealt, 3, 85)) == expected


def test_near_duplicates_of_odd_rows(odd, empty):
    found = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in lsh_forest.near_duplicates(odd[0], 3, 85).collect()}
    size = len(plain.shingle_set(odd[1][0][1], 3))
    assert found[900, size] == found[900, 2] == found[5, size] == (0, False)  # one node for both texts of an id
    assert found[None, size] == (None, True)
    assert found[901, 0] == (901, True)
    assert lsh_forest.near_duplicates(empty).count() == 0
    kept = [(r["doc_id"], r["text"]) for r in lsh_forest.keep_one(odd[0]).collect()]
    assert len(kept) == len(set(kept)) and (901, None) in kept and (900, odd[1][0][1]) not in kept


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)] + [(1, None), (4, 4)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if b is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {i: find(i) for i in root if find(i) != i}


def test_packing(docs, rows, odd, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for table, expected in ((docs, pairs(rows)), (odd[0], odd[1])):
        wanted = []
        for doc, text in expected:
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
            for piece in range(-(-len(ids) // 64)):
                part = ids[64 * piece : 64 * piece + 64]
                wanted.append((doc, piece, 64 * piece, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        found = packing.pack(table, TOKENIZER, capacity=64).collect()
        assert ordered(r[:5] for r in found) == ordered(wanted)
        sequences = {}
        for r in found:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for items in sequences.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= 64
        assert len(sequences) == plain_best_fit([w[3] for w in wanted], 64)
    assert packing.pack(empty, TOKENIZER).count() == 0


def plain_best_fit(lengths, capacity):
    open_bins = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in open_bins if r >= length]
        if fitting:
            open_bins.remove(min(fitting))
            open_bins.append(min(fitting) - length)
        else:
            open_bins.append(capacity - length)
    return len(open_bins)


def test_plan_is_best_fit():
    r = random.Random(7)
    for _ in range(100):
        capacity = r.choice([10, 64, 4096])
        lengths = [r.randint(1, r.choice([capacity, capacity // 4 + 1])) for _ in range(r.randint(1, 150))]
        histogram = {x: lengths.count(x) for x in lengths}
        table = packing.plan(histogram, capacity)
        used = {int(b) + i for n, _, b, _, each in table for i in range(1)}
        assert used and max(used) < plain_best_fit(lengths, capacity)


def test_word_ids():
    ids = packing.WordIds(open(TOKENIZER).read())
    tokenizer = Tokenizer.from_file(TOKENIZER)
    r = random.Random(5)
    texts = ["don't I'll x's", "Áb é ≠ İstanbul ΣΑΣ ς", "<|endoftext|>a <|ENDOFTEXT|> b<|startoftext|>.", "漢字、かな。…. a… b’s", "½ ² Ⅷ ﬁ ǅ ẞ", ""]
    texts += ["".join(r.choice("abAB.,'$%é́ß漢1٣ \n…’<|>") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    for text, found in zip(texts, ids.encode_all([t.encode() for t in texts])):
        assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_quality(spark, docs, rows, odd, empty):
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in [*range(0, 60, 2), 77]] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rated = quality.rate(docs, labels).collect()
    assert ordered((r["doc_id"], *r[2:7], r["base_failed"]) for r in rated) == ordered((i, *plain.base_quality(t)) for i, t in pairs(rows))
    assert not any(r["kept"] for r in rated if r["base_failed"])
    assert len(quality.rate(odd[0], labels).collect()) == len(odd[1])
    assert quality.rate(empty, labels).count() == 0
    unlabelled = quality.rate(docs, labels.where("false")).collect()
    assert all(r["kept"] != r["base_failed"] for r in unlabelled)
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in rated if r["kept"]}


def test_quality_tells_junk(spark):
    """Held-out documents: clean ones stay, junk goes."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known, unknown = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rated = quality.rate(table, known).join(unknown, "doc_id").where("not base_failed").groupBy("quality", "kept").count()
    n = {(r["quality"], r["kept"]): r["count"] for r in rated.collect()}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))


def test_best_threshold():
    assert quality.best_threshold(np.array([0.0, 1, 2, 3]), np.array([False, False, True, True])) == 1.5
    assert quality.best_threshold(np.array([1.0, 2]), np.array([True, True])) == -np.inf


def test_secrets(docs, rows, odd, empty):
    found = {r["doc_id"]: [f"{s['kind']}:{s['start']}:{s['stop']}" for s in r["spans"]] for r in secrets.find_secrets(docs).collect()}
    for i, t in pairs(rows):
        assert [s for s in found[i] if not s.startswith("markov")] == plain.secrets(t)
    assert secrets.find_secrets(odd[0]).count() == len(odd[1])
    assert secrets.find_secrets(empty).count() == 0


def test_secret_models(spark):
    """Held-out accuracy: fresh random strings, and long ordinary identifiers of documents that were not in training."""
    r = random.Random(6)
    letters = secrets.ALPHABET[:62]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    ratio = secrets.train(table.where("doc_id % 2 = 0"))
    fresh = ["".join(r.choice(a) for _ in range(r.randint(20, 48))) for a in (letters, letters[26:], "0123456789abcdef") for _ in range(100)]
    assert sum(secrets.likeness(x, ratio) >= secrets.MARGIN for x in fresh) >= 295
    words = [w for row in table.where("doc_id % 2 = 1").collect() for w in row["text"].split() if w.isascii() and w.isalpha()]
    ordinary = ["_".join(r.sample(words, 3)) if i % 2 else "".join(r.sample(words, 4)) for i in range(300)]
    assert sum(secrets.likeness(x, ratio) < secrets.MARGIN for x in ordinary) >= 295
    key = "".join(r.choice(letters) for _ in range(40))
    planted = spark.createDataFrame([(-1, f"plain words {key} more")], "doc_id long, text string")
    found = secrets.find_secrets(table.union(planted)).where("doc_id = -1").first()["spans"]
    assert [(s["kind"], s["start"], s["stop"]) for s in found] == [("markov", 12, 52)]


def plain_chunks(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        kept, gone = [], 0
        for _, size, chunk in line_chunks.chunks((t or "").encode()):
            if line_chunks.compared(chunk) and chunk in seen:
                gone += size
            else:
                kept.append(chunk)
            seen.add(chunk)
        out[i] = (gone, b"\n".join(kept).decode() if t is not None else None)
    return out


def test_line_chunks(docs, rows, odd, empty):
    found = {r["doc_id"]: (r["__removed"], r["text"]) for r in line_chunks.remove_repeated_chunks(docs).collect()}
    assert found == plain_chunks(pairs(rows))
    assert sum(gone for gone, _ in found.values()) > 0
    assert line_chunks.remove_repeated_chunks(odd[0]).count() == len(odd[1])
    assert line_chunks.remove_repeated_chunks(empty).count() == 0
    kept = line_chunks.keep_first_chunks(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (gone, t) in found.items() if not gone or t}


def test_every_repeated_long_line_goes(spark):
    """Long lines in texts whose other lines differ, without a look at the cuts."""
    r = random.Random(8)
    passages = [" ".join(f"w{r.randrange(10_000)}" for _ in range(r.randint(40, 90))) for _ in range(30)]
    texts = []
    for i in range(200):
        lines = [" ".join(f"own{r.randrange(10**6)}" for _ in range(r.randint(1, 30))) for _ in range(r.randint(0, 6))]
        lines.insert(r.randint(0, len(lines)), passages[i % 30])
        texts.append((i, "\n".join(lines)))
    left = line_chunks.remove_repeated_chunks(spark.createDataFrame(texts, "doc_id long, text string"))
    want = {i: "\n".join(x for x in t.split("\n") if i < 30 or x not in passages) for i, t in texts}
    assert {r["doc_id"]: r["text"] for r in left.collect()} == want


def test_chunks_do_not_shift():
    """Lines before a passage change no cut but those in its first part."""
    r = random.Random(9)
    passage = [f"line {r.random()} of the passage" for _ in range(60)]

    def late_cuts(lines):
        return {len(lines) - first for first, *_ in line_chunks.chunks("\n".join(lines).encode()) if len(lines) - first < 35}

    for before in range(1, 9):
        assert late_cuts([f"own {i}" for i in range(before)] + passage) == late_cuts(passage)


def test_language_model(docs, rows, odd, empty, monkeypatch):
    monkeypatch.setattr(language_model, "COMMON", 150)  # so that some words are joined
    monkeypatch.setattr(language_model, "CLASSES", 60)
    for table, expected in ((docs, pairs(rows)), (odd[0], odd[1])):
        found = ordered(language_model.score(table).collect())
        for got, want in zip(found, ordered(plain.unigram(expected)), strict=True):
            assert got[:5] == want[:5] and got[5] == pytest.approx(want[5])
    assert language_model.score(empty).count() == 0
    assert language_model.score(docs.where("doc_id = 4")).count() == 1  # may be held out: nothing is known


def test_language_model_is_normalised_and_learns():
    r = np.random.default_rng(2)
    model = language_model.Model([b"w%d" % i for i in range(18)], np.full(20, 100.0))
    # Every word is followed by one of two words.
    word = [2]
    for _ in range(20_000):
        word.append(2 + (2 * (word[-1] - 2) + int(r.integers(2))) % 18)
    stream = np.array(word, np.int32)
    trainer = language_model.Trainer(model, 1)
    for at in range(0, len(stream) - 2050, 512):
        part = stream[at : at + 514]
        trainer.step(part[:-2], part[1:-1], part[2:])
    first, second, norms = model.tables()
    total = np.exp(first[:, None, :] + second[None, :, :] - norms[:, :, None]).sum(axis=2)
    assert total == pytest.approx(1, abs=1e-3)
    a, b, w = stream[-2000:-2], stream[-1999:-1], stream[-1998:]
    log_p = first[a, w] + second[b, w] - norms[a, b]
    assert log_p.mean() > np.log(1 / 20) + 0.7


def test_overlaps(spark, docs, rows, odd, empty):
    r = random.Random(4)
    items = []
    for i in (1, 7, 20):
        w = rows[i][1].split()
        items.append((i, " ".join(w[3:33])))
        changed = w[3:33]
        for j in range(4, 30, 9):
            changed[j] = "substituted"
        items.append((100 + i, " ".join(changed).replace("a", "A").replace("é", "É")))
        items.append((200 + i, " ".join(r.sample(w, len(w))[:30])))
    items += [(300, "too short here"), (301, None), (302, ""), (303, "two words"), (304, "one")]
    w = rows[2][1].split()
    for n in (1, 2, 4, 5, 7, 8, 9, 10, 12, 13):
        items.append((400 + n, " ".join(w[5 : 5 + n])))
        items += [(500 + 20 * n + j, " ".join(w[5 : 5 + j] + ["other"] + w[6 + j : 5 + n])) for j in range(n) if n > 4]
    benchmark = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, h int, tokens int")
    found = ordered(decontamination.find_overlaps(docs, benchmark).drop("h").collect())
    assert found == ordered(plain.overlaps(pairs(rows), items))
    assert {(1, 1), (1, 101), (7, 7), (7, 107)} <= {(d, i) for d, i, *_ in found}
    assert decontamination.find_overlaps(empty, benchmark).count() == 0
    assert decontamination.find_overlaps(docs, benchmark.where("false")).count() == 0
    clean = decontamination.keep_clean(odd[0], benchmark)
    assert clean.columns == odd[0].columns
    passages = [(i, t) for i, t in items if len((t or "").split()) >= 5]
    bad = {d for d, *_ in plain.overlaps([(str(r), r[1]) for r in odd[1]], passages)}
    assert clean.count() == sum(str(r) not in bad for r in odd[1])


@pytest.mark.parametrize("n", range(1, 16))
def test_no_pattern_within_the_tolerance_is_missed(n):
    masks = [f for least, f in decontamination.FAMILIES if least <= n][-1]
    size = min(n, decontamination.WINDOW)
    spans = [{a + o for o in mask} for mask in masks for a in range(size - mask[-1])]
    allowed = size - -(-size * decontamination.PERCENT // 100)
    for changed in itertools.combinations(range(size), allowed):
        assert any(not span & set(changed) for span in spans), changed


def test_seeds_of_long_texts(spark, monkeypatch):
    """Pieces of a text give the seeds of the whole."""
    df = spark.range(1).select(F.lit(1).alias("id"), F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.xxhash64(i)).alias("tokens"))
    whole = ordered(decontamination.seeds(df, "id").collect())
    monkeypatch.setattr(decontamination, "PIECE", 7)
    assert ordered(decontamination.seeds(df, "id").collect()) == whole
    assert len(whole) == sum(61 - m[-1] for m in decontamination.MASKS)


URLS = [
    "http://a.example.org/en/1", "https://EXAMPLE.org/es/x?q", "http://b.example.com/fr/", "http://b.example.com/de/#top",
    "http://c.net/x", "no scheme", None, "", "http://org", "http://org/", "ftp://x.notorg/", "http://u@h:80/p?utm_source=a#b", "://?",
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "r") for i, u in enumerate(URLS + URLS[:2])] + [(None, URLS[0], "", "r")], "page_id long, url string, html string, rule string")
    found = {r["page_id"]: r for r in url_filters.judge(pages, url_filters.rules_table(spark)).collect()}
    assert len(found) == len(URLS) + 3
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain.verdict(u, url_filters.RULES)
        assert tuple(found[i][c] for c in ("host", "path", "rule")) == (host, path, rule)
        assert found[i]["verdict"] == (verdict or "allow")
    assert url_filters.judge(pages.where("false"), url_filters.rules_table(spark)).count() == 0


def test_url_aliases(spark):
    canonical = '<html><head><LINK rel="canonical" data-x=1 href="{}"></head>'
    pages = [
        (1, "http://x.net/a", canonical.format("https://y.net/b?utm_source=z")),
        (2, "http://y.net/b/", '<meta http-equiv="refresh" content="0; url=http://s.com/de/bad">'),  # blocked by a rule
        (3, "https://x.net/a#frag", None),
        (4, "http://z.net/c", canonical.format("//x.net/a/")),
        (5, "http://ok.org/d", canonical.format("http://x.net/a")),  # an explicit allow wins
        (6, "http://w.net/dir/e", canonical.format("f")),
        (7, "http://w.net/dir/f", "<a href='http://s.com/de/bad'>no alias</a>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["page_id"]: (r["verdict"], r["passed_on"]) for r in url_filters.judge(df, url_filters.rules_table(spark)).collect()}
    assert found == {1: ("block", True), 2: ("block", True), 3: ("block", True), 4: ("block", True), 5: ("allow", False), 6: ("allow", False), 7: ("allow", False)}


def test_archives(spark, folder):
    payloads = ["a" * 99, "a" * 99, "é" * 60, "é" * 60, "é" * 60, "", None, "head\r\n\r\nWARC/1.1\r\nbody" * 9]
    rows = [(i, f"http://h{i % 3}.Example.com/{'x' * i}?a#b", p, "f") for i, p in enumerate(payloads)]
    rows += [(None, None, "é" * 60, "f"), (4, "http://q.net", "é" * 60, "f"), (9, 'odd\r\n"line', "z" * 200, "f")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(3)
    found = warc.archive_and_read(pages, f"{folder}/archives").collect()
    assert len(found) == len(rows)
    import hashlib

    wanted = []
    for i, u, p, _ in rows:
        data = (p or "").encode()
        first = 2 if p == "é" * 60 and i != 2 else None
        wanted.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if first else "response", first, u))
    assert ordered(found) == ordered(wanted)
    assert warc.archive_and_read(pages.where("false")).count() == 0


def test_index_look_up(spark, folder):
    rows = [(i, f"http://h{i % 7}.example.com/{i % 40}", "page") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    captures = warc.write_archives(pages, folder)
    index = warc.build_index(captures, folder, block=16)
    wanted = spark.createDataFrame([("com,example,h3)/3", 3), ("com,example,h3)/3", 4), ("zz)", 1), ("", None)], "key string, page_id long")
    assert [(r["key"], r["page_id"]) for r in index.look_up(wanted).collect()] == [("com,example,h3)/3", 3)]
    assert index.look_up(captures).count() == 400
    assert warc.address_key("http://WWW.Ex.com:80/a?b#c") == "com:80,ex,www)/a?b"
