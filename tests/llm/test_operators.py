"""Small fixtures for every text operator: brute force, round trips and the defined edge cases."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import bpe, exact_dedup, license_scan, line_dedup, minhash, packing, quality, token_counts, toxicity, url_filter
from tessera.llm import queries as q
from tessera.llm.common import tokenizer_file
from tests.conftest import SF

RANKS, VOCAB = tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, kept int, n_words string, row int"
LONG = " ".join(f"word{i}" for i in range(20000))
ROWS = [(0, None), (1, ""), (2, " \n\t "), (3, "One  two."), (4, "one two."), (4, "one two."), (None, "no id at all"),
        (5, LONG), (6, LONG + " x"), (7, "a" * 3000), (8, "Ünï 日本 'll don't\n\n  x"), (9, "OneTwo."), (9, "other text"), (10, ""),
        (11, None), (12, "between empty ones"), (13, ""), (14, "spelt <|endoftext|> out"), (15, "")]


@pytest.fixture(scope="module")
def odd(spark):
    """In one partition, so that empty texts stand first, between others and last in one batch."""
    return spark.createDataFrame([(i, t, None, 7, "clash", 1) for i, t in ROWS], SCHEMA).coalesce(1)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup_edges(odd, empty):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(odd).collect()}
    assert set(got) == {(i, hashlib.sha256(bare(t).encode()).hexdigest()) for i, t in ROWS}
    blank = hashlib.sha256(b"").hexdigest()
    assert got[2, blank]["kept"] and not got[0, blank]["kept"] and got[0, blank]["group_size"] == 7
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_tells_collisions_apart(odd):
    weak = lambda c: exact_dedup.F.length(c) % 2
    strong = {tuple(r) for r in exact_dedup.exact_groups(odd).collect()}
    assert {tuple(r) for r in exact_dedup.exact_groups(odd, weak).collect()} == strong


def test_bpe_equals_library_and_decodes(odd, empty):
    import tiktoken
    from public_tokenizers import PATTERN
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS).rank, special_tokens={})
    encoded = bpe.encode(odd, RANKS)
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in encoded.collect())
    assert got == sorted((str(i), enc.encode_ordinary(t or "")) for i, t in ROWS)
    back = sorted((str(r["doc_id"]), bytes(r["bytes"])) for r in bpe.decode(encoded, RANKS).collect())
    assert back == sorted((str(i), (t or "").encode()) for i, t in ROWS)
    assert bpe.digests(odd, RANKS).count() == len(ROWS) and bpe.digests(empty, RANKS).count() == 0


def test_bpe_long_pieces_equal_short_ones():
    ranks = bpe.load_ranks(RANKS)
    rng = np.random.default_rng(3)
    words = [bytes(rng.choice(list(b"aeinrst '1"), int(n)).tolist()) for n in rng.integers(2, 64, 500)]
    for n in {(len(w) - 1).bit_length() for w in words}:
        group = [w for w in words if (len(w) - 1).bit_length() == n]
        assert bpe.merge_many(group, ranks) == [bpe.merge_long(w, ranks) for w in group]


def test_url_filter_edges(spark):
    rows = [(1, "http://NET/"), (2, "http://net"), (None, None), (4, "https://a.b.example.net/en/x?y#z"), (5, "nothing"),
            (6, "ftp://Example.COM/de/"), (6, "ftp://Example.COM/de/"), (7, "x://example.net?/en/"), (8, "http://internet/"),
            (9, "http://cheap-pills.example.com/fr/1")]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in rows], "page_id long, url string, html string, host string")
    got = sorted(((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()),
                 key=str)
    assert got == sorted([
        (1, "net", "/", "net/", "block"), (2, "net", "", None, "allow"), (0, "", "", None, "allow"),
        (4, "a.b.example.net", "/en/x", "example.net/en/", "allow"), (5, "", "", None, "allow"),
        (6, "example.com", "/de/", "example.com/de/", "block"), (6, "example.com", "/de/", "example.com/de/", "block"),
        (7, "example.net", "", None, "allow"), (8, "internet", "/", None, "allow"),
        (9, "cheap-pills.example.com", "/fr/1", None, "block")], key=str)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_filter_many_rules(spark):
    """400 host rules and 100 patterns against every rule run on every url."""
    rng = np.random.default_rng(9)
    labels = ["shop", "news", "blog", "cdn", "img", "static", "forum"]
    hosts = [".".join(rng.choice(labels, rng.integers(1, 3))) + f"{'' if k % 3 else k % 40}.{('net', 'org', 'com')[k % 3]}" for k in range(400)]
    paths = ["/", "/en/", "/en/a/", "/de/"]
    rules = {h + p: url_filter.host_rule(h, p, ("allow", "block")[int(rng.integers(2))])
             for h, p in zip(hosts, rng.choice(paths, len(hosts)))}
    own = {f"t{k}": url_filter.UrlRule(f"t{k}", "block", rf"/tag{k}(?:/|$)", (f"tag{k}",)) for k in range(100)}
    given = (*rules.values(), *own.values())
    urls = [f"http://{rng.choice(['', 'www.', 'a.b.', 'x'])}{hosts[int(rng.integers(400))].upper() if k % 5 == 0 else hosts[int(rng.integers(400))]}"
            f"{rng.choice(['', *paths])}{rng.choice(['', f'tag{k % 130}', f'tag{k % 130}/x', 'Tag1', '?en'])}" for k in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def truth(url):
        host, path = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url).groups()
        host = host.lower()
        fits = [r for r in given if re.search(r.pattern, host + path)]
        base = max((r for r in fits if r.rank), key=lambda r: (len(r.name), r.name), default=None)
        other = max((r for r in fits if not r.rank), key=lambda r: (len(r.name), r.name), default=None)
        return (host, path, base and base.name, base.verdict if base else other.verdict if other else "allow", other and other.name)

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["method_rule"])
           for r in url_filter.filter_urls(pages, given).collect()}
    assert got == {i: truth(u) for i, u in enumerate(urls)}
    assert len({r[2] for r in got.values()}) > 50 and len({r[4] for r in got.values()}) > 50


def test_license_scan_brute_force(spark, docs, odd, empty):
    texts = docs.select("doc_id", "text").collect() + [(-1, "MIT License, the mit-license; cc by cc by"), (-2, None)]
    data = spark.createDataFrame([tuple(r) for r in texts], "doc_id long, text string")
    phrases = {t.label: t.text.split() for t in license_scan.BASE_PHRASES}
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(data).collect()}
    for i, t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = sorted((k, label) for label, p in phrases.items() for k in range(len(w)) if w[k:k + len(p)] == p)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert license_scan.scan_licenses(odd).count() == len(ROWS) and license_scan.scan_licenses(empty).count() == 0


def test_license_templates_within_chains(spark):
    """A template followed by more of its own pairs, with words between, cut short, in disorder, and with capitals."""
    gpl = next(t.text for t in license_scan.METHOD_TEMPLATES if t.label == "gpl").split()
    texts = ["licensed under cc by nc 4 0", "licensed under cc by nc 4 0" + " 4 0" * 40, "4 0 " * 30 + "licensed under cc by nc 4 0 4 0",
             " ".join(gpl[:8] + ["also"] + gpl[8:]), " ".join(gpl[:6]), " ".join(reversed(gpl)), "word " * 50 + " ".join(gpl).upper() + " more" * 50,
             "licensed under x x x x x x x x x x x x cc by x x x x x x x x x x x nc 4 0"]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weak = lambda a, b: (license_scan.F.length(a) * 10 + license_scan.F.length(b)).cast("long")
    for made in (license_scan.scan_licenses(data), license_scan.scan_licenses(data, pair_hash=weak)):
        got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in made.collect()}
        assert [got[i][0] for i in range(8)] == ["cc-by,cc-by-nc", "cc-by,cc-by-nc", "cc-by,cc-by-nc", "gpl", "", "", "gpl", "cc-by"]
        assert [got[i][1] for i in range(8)] == ["cc-by", "cc-by", "cc-by", "gpl", "", "", "gpl", "cc-by"]
    scores = {r["doc_id"]: r["score"] for r in license_scan.scan_licenses(data).collect()}
    assert scores[1] == 1.0 and scores[4] == 0.0 and all(0 <= x <= 1 for x in scores.values())


def test_quality_edges(odd, empty):
    got = quality.judge_quality(odd).collect()
    assert len(got) == len(ROWS) and quality.judge_quality(empty).count() == 0
    long = [r for r in got if r["doc_id"] == 5][0]
    assert (long["n_words"], long["n_repeat_words"], long["kept"]) == (20000, 0, True)
    assert quality.keep_good(odd).columns == odd.columns


def test_quality_gives_the_cleaned_text(spark):
    prose = [" ".join(f"word{k}x{i}" for i in range(20)) for k in range(4)]
    lines = [prose[0], "home | about | help | contact", prose[1], "", "--- 1 ---", "We use cookies: read more", prose[2], prose[3]]
    rows = [(1, "\n".join(lines), 7), (1, "\n".join(prose), 7), (None, "\n".join(lines[:2]), 7), (2, None, 7)]
    data = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    clean = "\n".join(prose)
    got = [(r["doc_id"], r["clean_text"], r["kept"], r["n_removed_lines"]) for r in quality.cleaned(data).collect()]
    assert sorted(got, key=str) == sorted([(1, clean, True, 3), (1, clean, True, 0), (None, prose[0], False, 1), (2, "", False, 0)],
                                          key=str)
    assert [tuple(r) for r in quality.keep_good(data).collect()] == [(1, clean, 7)] * 2
    assert [tuple(r) for r in corpus_pipeline.quality_stage(spark, data, SF).collect()] == [(1, clean, len(clean))] * 2


def test_packing(odd, empty):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(VOCAB)
    rows = packing.pack(odd, VOCAB).collect()
    ids = {(i, t): tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in ROWS}
    assert sum(r["length"] for r in rows) == sum(len(ids[x]) for x in ROWS)
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    one = sorted(((r["doc_id"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] not in (5, 6, 7)), key=str)
    assert one == sorted(((i, len(x), crc(x)) for (i, _), x in zip(ROWS, map(ids.__getitem__, ROWS)) if i not in (5, 6, 7)), key=str)
    whole = np.array(ids[5, LONG], "<u4")
    mine = sorted((r for r in rows if r["doc_id"] == 5), key=lambda r: r["piece"])
    assert [r["length"] for r in mine[1:]] == [1024] * (len(mine) - 1)
    assert all(zlib.crc32(whole[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in mine)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024
    assert packing.pack(empty, VOCAB).count() == 0


def test_plan_keeps_every_capacity():
    rng = np.random.default_rng(5)
    counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 101), 40, False), rng.integers(1, 30, 40))}
    for cap in (packing.Capacity(100, 100, 10**4), packing.Capacity(100, 3, 10**4), packing.Capacity(100, 50, 10**4, (1, 1, 1), "dot")):
        bins, placed = {}, dict.fromkeys(counts, 0)
        for r in packing.plan(counts, cap):
            for n in range(r["a"], r["b"]):
                k = (n - r["a"]) // r["per"]
                bins.setdefault(r["first"] + k, []).append((r["offset"] + (n - r["a"]) % r["per"] * r["length"], r["length"]))
                placed[r["length"]] += 1
        assert placed == counts
        for b in map(sorted, bins.values()):
            assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))]
            assert sum(n for _, n in b) <= cap.tokens and len(b) <= cap.documents


def _truth(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_minhash_equals_brute_force(docs, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == _truth(rows)
    edge = minhash.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in edge}
    assert by[0]["n_shingles"] == 0 and by[1]["kept"] and by[6]["component_id"] == 5 and by[4]["component_id"] == 3
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_several_texts_of_one_id(spark):
    rng = np.random.default_rng(21)
    base, other, third = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 80)) for _ in range(3))
    z = lambda t: t + " z"
    rows = [(10, base), (10, other), (20, base), (30, z(base)), (40, other), (50, z(other)), (60, third), (70, z(third)), (80, base),
            (80, third), (None, other), (90, None), (90, "one two")]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(data).collect()}
    assert got == {*((i, 10) for i in (10, 20, 30, 40, 50, 60, 70, 80)), (None, None), (90, 90)}
    apart = spark.createDataFrame([r for r in rows if r[0] != 80], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(apart).collect()}
    assert got == {*((i, 10) for i in (10, 20, 30, 40, 50)), (60, 60), (70, 60), (None, None), (90, 90)}


def test_minhash_tells_words_of_equal_sums_apart(spark):
    data = spark.createDataFrame(list(enumerate(_odd_words())), "doc_id long, text string")
    assert sorted(r["component_id"] for r in minhash.near_duplicates(data).collect()) == [0, 1]


def test_minhash_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.choice(100, int(rng.integers(0, 5)), False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    data = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(data).collect()}
    assert got == _truth(rows)


def test_toxicity_learns_and_holds_out(spark, empty):
    rng = np.random.default_rng(2)
    common = [f"plain{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(common, 30))
        if i % 4 == 0:
            for k in range(3):
                w[k * 7] = str(rng.choice(["vileword", "v1leword", "grimstem" + str(rng.choice(common))]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, toxicity.fit(docs, marks)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    wrong = [i for i, t in labels if got[i]["held_out"] and got[i]["predicted"] != t]
    assert len(wrong) <= 2 and got[1000]["predicted"] == 0 and got[1001]["predicted"] == 0
    none = toxicity.fit(docs, marks.limit(0))
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(empty, none).count() == 0


@pytest.mark.parametrize("text", ["trash", "TR4SH", "тrаsh", "тяash".replace("я", "r"), "ｔｒａｓｈ", "tráshy".rstrip("y"), "t r a s h", "T.R.A.S.H",
                                  "t_r_a_s_h", "tr\u200bash", "𝐭𝐫𝐚𝐬𝐡", "ⓣⓡⓐⓢⓗ", "τrαѕh", "ᴛʀᴀsʜ", "t-r-@-$-h"])
def test_toxicity_folding(text):
    assert toxicity.folded(f"see {text} here") == " see trash here "


def _plain_measure(text, lexicon, exceptions):
    """Hits by looking at every word on its own and every phrase at every place."""
    words = toxicity.folded(text or "").split()
    line = " " + " ".join(words) + " "
    at, places = 0, []
    for w in words:
        places.append(at)
        at += len(w) + 1
    best = {}
    for w, p in zip(words, places):
        fits = [v for t, v in lexicon.items() if v > 0 and (t == f" {w} " if t.endswith(" ") else f" {w}".startswith(t))]
        if fits and lexicon.get(f" {w} ") != 0.0:
            best[p] = max(fits)
    for phrase in exceptions:
        k = line.find(f" {phrase} ")
        while k >= 0:
            best = {p: v for p, v in best.items() if not k <= p < k + len(phrase) + 1}
            k = line.find(f" {phrase} ", k + 1)
    return float(len(best)), sum(best.values()), float(max(1, len(words)))


def test_toxicity_measures_equal_brute_force(spark):
    rng = np.random.default_rng(13)
    words = ["trash", "trashy", "trashcan", "can", "the", "vile", "viler", "Vi1e", "bin", "clown", "fish", "clownish", "a", "b", "c"]
    lexicon = {" trash": 3.0, " trashy ": 0.0, " vile": 2.5, " vile ": 4.0, " clown": 2.75, " can ": 3.5, " clownish ": 0.0}
    exceptions = ("trash can", "clown fish", "trash bin")
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 14, 400)] + [None, "", "...", "trash can trash can trash"]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: tuple(r["m"]) for r in data.select("id", toxicity.measures(lexicon, exceptions)("text").alias("m")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(_plain_measure(t, lexicon, exceptions)), t


def test_toxicity_with_ties_and_clashing_columns(spark):
    rows = [(i, ("vileword " if i % 4 == 0 else "plain ") + "same text", "clash", 5) for i in range(200)] + [(7, None, "x", 1), (None, "vileword", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic int")
    marks = spark.createDataFrame([(i, int(i % 4 == 0), "z") for i in range(200)] + [(3, 0, "z")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, marks)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) and {(r["doc_id"] % 4 == 0, r["predicted"]) for r in got if r["doc_id"] not in (None, 7)} == {(True, 1), (False, 0)}
    assert [r["predicted"] for r in got if r["doc_id"] is None] == [1]
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == 151


def test_token_counts(docs, empty):
    counted = token_counts.count_tokens(docs, RANKS)
    n = sorted(r["n_tokens"] for r in counted.collect())
    hist = token_counts.length_histogram(counted)
    for r in hist.collect():
        c = r["n_tokens"]
        assert (r["n_docs"], r["docs_longer"]) == (n.count(c), sum(x > c for x in n))
        assert (r["tokens_fitting"], r["tokens_longer"]) == (sum(x for x in n if x <= c), sum(x for x in n if x > c))
        assert r["truncated_total"] == sum(min(x, c) for x in n)
    assert [tuple(r) for r in token_counts.at_limits(hist, [0, 100, 10**6]).collect()] == [
        (c, sum(x <= c for x in n), sum(min(x, c) for x in n)) for c in (0, 100, 10**6)]
    assert token_counts.quantile_length(hist, 0.5).first()[0] == n[(len(n) + 1) // 2 - 1]
    assert token_counts.length_histogram(token_counts.count_tokens(empty, RANKS)).count() == 0


def _line_truth(rows):
    lines = sorted((i, k, x.strip(" \t\n\x0b\x0c\r").lower()) for i, t in rows for k, x in enumerate((t or "").split("\n")))
    lines = [x for x in lines if x[2]]
    forms = {}
    for i, k, x in lines:
        forms.setdefault(x, (i, k))
    near = {}
    for a, b in itertools.combinations([f for f in forms if len(f) >= line_dedup.MIN_CHARS], 2):
        if abs(len(a) - len(b)) < 2 and line_dedup.one_edit(a, b):
            near.setdefault(a, []).append(forms[b])
            near.setdefault(b, []).append(forms[a])
    return {(i, k): min([forms[x], *near.get(x, [])]) for i, k, x in lines}


def test_line_dedup(spark, odd, empty):
    rng = np.random.default_rng(4)
    base = ["the quick brown fox jumps over it", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ähnlich ïst dïese zeile hier", "short"]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(4):
            x = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 3)):
                k = int(rng.integers(len(x)))
                x[k:k + int(rng.integers(0, 2))] = list(rng.choice(["", "z", "a", "é"]))
            lines.append("".join(x))
        rows.append((i, "\n".join(lines)))
    data = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line"]): (r["first_doc_id"], r["first_line"]) for r in line_dedup.line_verdicts(data).collect()}
    assert got == _line_truth(rows)
    assert line_dedup.line_summary(odd).count() == len({i for i, _ in ROWS}) and line_dedup.line_summary(empty).count() == 0
    assert line_dedup.drop_lines(odd).columns == odd.columns


@pytest.mark.parametrize("a,b,near", [("abc", "abc", True), ("abc", "abd", True), ("abc", "ab", True), ("abc", "xabc", True),
                                      ("abc", "axbxc", False), ("abc", "acb", False), ("", "a", True)])
def test_one_edit(a, b, near):
    assert line_dedup.one_edit(a, b) is near


def test_drop_functions_keep_each_document_once(spark):
    rng = np.random.default_rng(12)
    one, two, three, four, five = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 80)) for _ in range(5))
    near = " ".join(one.split()[:-1] + ["other"])
    rows = [(1, one, "de"), (1, one, "de"), (1, one + " ", "de"), (2, two, "de"), (2, one, "de"), (None, one, "de"),
            (None, three, "de"), (None, three, "fr"), (None, four, "de"), (3, five, "de"), (3, five, "de"), (4, near, "de"),
            (5, None, "de"), (5, "", "de")]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    key = lambda r: (r["doc_id"] or 0, bare(r["text"]))
    exact = exact_dedup.drop_exact_copies(data)
    assert exact.columns == data.columns
    left = exact.collect()
    assert sorted(map(key, left)) == sorted((i, bare(t)) for i, t in [
        (1, one), (2, two), (0, three), (0, four), (3, five), (4, near), (5, "")])
    assert [r["text"] for r in left if r["doc_id"] == 1] == [one + " "]
    alone = minhash.drop_near_copies(data)
    assert alone.columns == data.columns
    assert sorted(map(key, alone.collect())) == sorted((i, bare(t)) for i, t in [
        (1, one), (2, two), (0, one), (0, three), (0, four), (3, five), (5, "")])
    assert sorted(map(key, minhash.drop_near_copies(exact).collect())) == sorted((i, bare(t)) for i, t in [
        (1, one), (2, two), (0, three), (0, four), (3, five), (5, "")])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in left.collect()}
    assert len({bare(t) for t in rows.values()}) == len(rows)
    truth = _truth(rows.items())
    assert all(c == i for i, (_, c) in truth.items())
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == set(rows)


def _plain_pipeline(rows, toxic):
    """All five stages in plain Python: rows (doc_id, text), ids that the toxicity stage rejects."""
    import regex
    from tokenizers import Tokenizer
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    syms = lambda t: len(re.findall(r"[#*$%&|<>]", t))

    def bad(line):
        w = words(line)
        return ((line.count("|") >= 3 and line.count("|") * 4 >= len(w)) or (2 * len(re.findall("!{2,}", line)) >= max(6, len(w)))
                or 2 * syms(line) >= max(6, len(w)) or (len(w) >= 12 and 4 * len(set(w)) <= len(w))
                or (len(w) <= 25 and any(p in line.lower() for p in quality.BOILERPLATE)) or not regex.search(r"\p{L}", line))

    def good(text):
        w = words(text)
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(set(grams)) < len(grams) else ()
        lines = [x for x in text.split("\n") if words(x)]
        kept = [x for x in lines if not bad(x)]
        lost = sum(map(len, lines)) - sum(map(len, kept))
        fails = len(w) < 50 or 100 * len(again) > 50 * len(w) or 100 * lost > quality.MAX_LOST_PERCENT * sum(map(len, lines))
        return None if fails else "\n".join(kept)
    stages = [{i: t or "" for i, t in rows if i not in toxic}]
    stages.append({i: c for i, t in stages[0].items() if (c := good(t)) is not None})
    best = {}
    for i, t in sorted(stages[1].items(), key=lambda r: (-len(r[1]), r[0])):
        best.setdefault(bare(t), i)
    stages.append({i: stages[1][i] for i in best.values()})
    linked = _truth(stages[2].items())
    stages.append({i: t for i, t in stages[2].items() if linked[i][1] == i})
    tok, pieces = Tokenizer.from_file(VOCAB), set()
    for i, t in stages[3].items():
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            b = first if not k else a + 1024
            pieces.add((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return stages, pieces


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.scored(docs, model).collect() if r["predicted"]}
    stages, pieces = _plain_pipeline(rows, toxic)
    left = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], stages):
        left = stage(spark, left, SF)
        got = [(r["doc_id"], r["text"] or "") for r in left.select("doc_id", "text").collect()]
        assert len(got) == len(want) and dict(got) == want, name
    packed = corpus_pipeline.run(spark, SF).collect()
    assert len(packed) == len(pieces)
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed} == pieces
    whole = sum(n for *_, n, _ in pieces)
    assert len({r["sequence_id"] for r in packed}) <= -(-whole // 1024) * 1.02 + 2


def test_pipeline_of_odd_tables(spark):
    """Null ids, repeated rows, an empty table, and stages that nothing reaches."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(3)]
    rows = [(None, good[0]), (None, good[0]), (None, good[1]), (5, good[2]), (5, good[2]), (6, None), (7, ""), (8, "short")]
    for data, n in (([(i, t, "en", "s", len(t or "")) for i, t in rows], 3), ([], 0), ([(1, "short", "en", "s", 5)], 0)):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", "), name
        assert docs.count() == n
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").count() == n


def test_queries_are_registered():
    assert {name.split("_")[0] for name in q.QUERIES} == {f"op{n}" for n in range(1, 14)}


def _odd_words():
    """Two words whose letters' sums with powers of any odd base are equal modulo 2**64."""
    return ["".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(1024)) for flip in (0, 1)]


@pytest.mark.parametrize("texts", [["x", "", "y"], ["", "", " \n\t "], [""], ["", ""], ["x", ""], ["a b", "", "", "c", ""],
                                   _odd_words(), ["one " + _odd_words()[0], "", _odd_words()[1] + " two"]])
def test_empty_texts_and_equal_hashes(spark, texts):
    """Ids of every text equal the libraries', wherever texts without characters stand and whatever their hashes."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer
    ranks = bpe.load_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    want = [enc.encode_ordinary(t) for t in texts]
    assert [x.tolist() for x in bpe.encode_texts(texts, ranks)] == want
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [r["n_tokens"] for r in token_counts.count_tokens(data, RANKS).collect()] == [len(x) for x in want]
    tok = Tokenizer.from_file(VOCAB)
    ids = [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    packed = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(data, VOCAB).where("piece = 0").collect()}
    assert packed == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids) if len(x) <= 1024} | {
        i: v for i, v in packed.items() if len(ids[i]) > 1024}


def test_fast_ids_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(VOCAB)
    rng = np.random.default_rng(7)
    points = [32, 10, 9, 13, 11, 0x85, 0xA0, 0x1C, 0x180E, 0x200B, 0x3000, 39, 115, 116, 0x2019, 97, 65, 0x130, 0xE9, 0x301, 48, 0xB2,
              33, 0x1F600, 0xFE0F, 0, 0xAD, 0x4E00, 0x0E31]
    texts = ["".join(chr(int(c)) for c in rng.choice(points, int(n))) for n in rng.integers(0, 30, 3000)]
    texts += [" " * 2_000_000, "\n" * 200_000 + "x", "a" * 50_000, "<|endoftext|>"]
    for text, ids in zip(texts, packing.token_ids(texts, VOCAB)):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
