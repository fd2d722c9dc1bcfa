"""Training-data operators against brute force, round trips and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("labelworks.llm")

from labelworks.llm import (  # noqa: E402
    decontaminate,
    exact,
    extract,
    licenses,
    lm_score,
    near,
    packing,
    substrings,
    toxicity,
    warc,
)
from labelworks.llm.common import hashes_of_texts, word_hashes  # noqa: E402

ROWS = "doc_id long, text string, n_words string, key string, norm string, row string, node string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in rows], ROWS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, copies with other white space."""
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, base[0] + "  "), (11, base[0]), (11, base[0]), (12, None), (13, ""), (14, " \n"), (None, base[1])]
    rows += [(15, base[2].replace(" ", "\t", 3)), (16, base[3] + " tail"), (17, prose(rng, 30_000)), (18, "one two")]
    return rows


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_exact_against_brute_force(spark, awkward):
    norm = {}
    for i, t in awkward:
        norm.setdefault("".join(c for c in (t or "") if c not in " \t\n\r\x0b\x0c"), []).append((i, t or ""))
    got = exact.exact_duplicates(docs_of(spark, awkward), capacity=2, max_depth=6).collect()
    assert len(got) == len(awkward)
    for text, group in norm.items():
        best = min(group, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        name = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == name]
        assert Counter(r.doc_id for r in mine) == Counter(i for i, _ in group)
        assert all(r.keep_id == best and r.group_size == len(group) and r.kept == (r.doc_id == best) for r in mine)
    kept = exact.drop_exact(docs_of(spark, awkward))
    assert kept.columns == docs_of(spark, []).columns
    assert kept.count() == len(norm)
    assert exact.exact_duplicates(docs_of(spark, [])).count() == 0


def test_directory_splits_overfull_buckets(spark):
    entries = spark.range(1000).selectExpr("id % 16 as cell").filter("cell < 4 or id < 500")
    found = {r.cell: r for r in exact.directory(entries, 120, 4).collect()}
    held = Counter()
    for r in entries.collect():
        held[found[r.cell].bucket] += 1
    assert all(n <= 120 or found[b].local_depth == 4 for b, n in held.items())
    assert len({r.local_depth for r in found.values()}) > 1


def test_near_against_brute_force(spark, awkward):
    rng = random.Random(8)
    rows = list(awkward)
    for k in range(6):
        words = rows[k][1].split()
        for j in range(3):
            changed = list(words)
            for _ in range(j + 1):
                changed[rng.randrange(len(changed))] = "changed"
            rows.append((100 + 10 * k + j, " ".join(changed)))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    want = []
    for i, (d, _) in enumerate(rows):
        ids = [e for k, (e, _) in enumerate(rows) if root(k) == root(i) and e is not None]
        want.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    got = near.near_duplicates(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    assert near.near_duplicates(docs_of(spark, [])).count() == 0


def test_decontamination_against_brute_force(spark, awkward):
    items = [(1, awkward[0][1]), (2, "one two"), (3, None), (4, ""), (None, awkward[4][1][:80]), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() or c >= "\x80" else " " for c in t or "").split()

    windows = []
    for i, t in items:
        w = words(t)
        windows += [(i, w[a : a + min(10, len(w))]) for a in range(len(w) - min(10, len(w)) + 1) if w]
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(docs_of(spark, awkward), bench).collect()}
    for d, t in awkward:
        w = words(t)
        hit, found = set(), set()
        for i, x in windows:
            for a in range(len(w) - len(x) + 1):
                if w[a : a + len(x)] == x:
                    hit |= set(range(a, a + len(x)))
                    found |= {str(i)} - {"None"}
        r = got[d, len(w)]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(hit), len(found), digest, bool(hit))
    clean = decontaminate.clean_documents(docs_of(spark, awkward), bench)
    assert clean.columns == docs_of(spark, []).columns
    assert 0 < clean.count() < len(awkward)
    assert decontaminate.contamination(docs_of(spark, awkward), bench.limit(0)).filter("contaminated").count() == 0


def test_substrings_against_brute_force(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcé ") for _ in range(3000))
    rows = [(1, text), (2, "x" + text[500:900]), (3, text[:150]), (4, "ab" * 300), (5, None), (6, ""), (7, text[1000:1230])]
    rows += [(8, text[700:950] + text[100:330]), (9, "q" * 199), (9, "q" * 199)]
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + 200] for _, b in raw for i in range(len(b) - 199))
    want = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    for group in (substrings.GROUP, 1):
        old, substrings.GROUP = substrings.GROUP, group
        try:
            got = substrings.repeat_report(docs_of(spark, rows)).collect()
        finally:
            substrings.GROUP = old
        assert Counter(tuple(r) for r in got) == Counter(want)


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b/\r\nX: y", None), (4, "http://b/2", ""), (None, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_and_read(pages).collect()}
    assert got[2].record_type == "revisit" and got[2].refers_to == 1 and got[1].record_type == "response"
    assert got[4].record_type == "revisit" and got[4].refers_to == 3 and got[4].payload_bytes == 0
    assert got[1].payload_digest == warc.sha1_base32("<p>é</p>".encode()) and got[None].record_type == "response"
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages, folder)
    back = warc.read_archives(spark, folder)
    assert {bytes(r.payload) for r in back.filter("warc_type = 'response'").collect()} == {"<p>é</p>".encode(), b"", b"z"}
    assert back.filter("target_uri like 'http://b/%'").count() == 2
    for f in tmp_path.rglob("*.idx"):
        f.unlink()  # without an index the records are found by reading on
    assert warc.read_archives(spark, folder).count() == len(rows)


def test_packing_round_trip(spark, awkward):
    got = packing.pack(docs_of(spark, awkward), vocabulary()).collect()
    whole = packing.tokenizer(vocabulary()).whole
    for d, t in dict(awkward).items():
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        mine = {(r.start, r.length, r.ids_crc32) for r in got if r.doc_id == d and r.doc_tokens == len(ids)}
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert {(s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for s, n, _ in mine} == mine
        assert sum(n for _, n, _ in mine) == len(ids)
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= packing.MAX_LENGTH
    assert packing.pack(docs_of(spark, []), vocabulary()).count() == 0


def test_extraction():
    page = (
        "<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav>"
        "<div class='cookie-notice'>Cookies</div><article><h1>A &amp; B</h1><p>One <b>bold</b>\n text.<p>Two"
        "<script>x='</p>'</script><form>Mail</form><section class=comments><p>C</p></section></article><footer>F</footer>"
    )
    assert extract.main_text(page, set()) == "A & B\nOne bold text.\nTwo"
    assert extract.main_text(None, set()) == extract.main_text("", set()) == ""
    assert extract.main_text("<div><p>Kept</p></div><div class=x><p>Gone</p></div>", {"/div.x/p"}) == "Kept"


def test_style_tree_finds_boilerplate(spark):
    rows = [(i, "http://s/x", f"<div class=t><p>Same line</p></div><div class=c><p>Own text {i}</p></div>") for i in range(20)]
    rows += [(90, None, None), (91, "http://s/y", "")]
    got = {r.page_id: r for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Own text 3" and got[90].text == "" and got[91].n_chars == 0


def test_importance_decides_inside_and_outside_main_elements(spark):
    """Repeated unnamed branches in an article go; text beside teaser articles stays; names are a prior."""
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(20):
        own = [prose(rng, 9) for _ in range(1 + i % 3)]
        page = "<nav><a>Home</a></nav><article class=full><p>" + "<p>".join(own) + "<div class=promise>Made with care</div></article>"
        rows.append((i, "http://a/x", page + f"<div class=ad>{prose(rng, 5)}</div><p hidden>{prose(rng, 5)}</p>"))
        want[i] = "\n".join(own)
        body = prose(rng, 9)
        rows.append((100 + i, "http://b/x", f"<div class=story><p>{body}</p></div><article class=card>Read this too</article>"))
        want[100 + i] = body
        rows.append((200 + i, "http://c/x", "<article><p>Copies count once</article>"))
        want[200 + i] = "Copies count once"
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_licenses():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = random.Random(2)
    for name, notice in licenses.TEMPLATES.items():
        text = f"{prose(rng, 50)} {notice} {prose(rng, 70)}"
        assert [m[0] for m in scanner.find(text)] == [name]
    assert scanner.find(None) == scanner.find("") == scanner.find(prose(rng, 500)) == []


def test_altered_licenses_against_brute_force(spark):
    rng = random.Random(12)
    scanner = licenses.Scanner(licenses.TEMPLATES)

    def grams(t):
        w = re.findall(r"[a-z0-9]+(?:[-._'][a-z0-9]+)*", t.lower())
        return [tuple(w[i : i + 3]) for i in range(len(w) - 2)]

    def holds(text, template, longer):
        want, have = set(grams(template)), grams(text)
        n = len(grams(template))
        size = n + max(1, n // 4) * longer
        return any(len(want & set(have[i : i + size])) >= 0.8 * len(want) for i in range(max(1, len(have) - size + 1)))

    for _ in range(4):
        for notice in licenses.TEMPLATES.values():
            words = notice.split()
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(words))
                words[i : i + 1] = rng.choice([[], ["changed"], [words[i], "(added)"], [words[i] + ","], ['"' + words[i].upper() + '"']])
            text = f"{prose(rng, 40)} ({' '.join(words)}, see {prose(rng, 30)}"
            got = {m[0] for m in scanner.find(text)}
            assert {k for k, v in licenses.TEMPLATES.items() if holds(text, v, False)} <= got
            assert got <= {k for k, v in licenses.TEMPLATES.items() if holds(text, v, True)}
    lines = ["Licensed under CC BY-NC 4.0 (see x)", "Released under the MIT License, ok", "x (Licensed under the Apache License, Version 2.0)", "\u00a9 A. All rights reserved."]
    assert [[m[0] for m in scanner.find(t)] for t in lines] == [["CC-BY-NC-4.0"], ["MIT"], ["Apache-2.0"], ["all-rights-reserved"]]
    assert scanner.find(lines[2])[0][1:3] == (1, 8)
    table = spark.createDataFrame([("Own", "One two three four."), ("Own", "Five six seven.")], "license string, text string")
    got = licenses.license_matches(docs_of(spark, [(1, "a five six seven; one two three four")]), table).collect()
    assert [m.license for m in got[0].matches] == ["Own", "Own"]


def test_pseudo_likelihood_prefers_seen_order(spark):
    rng = random.Random(4)
    words = [prose(rng, 1) for _ in range(30)]
    line = " ".join(words)
    rows = [(i, " ".join([line] * 40)) for i in range(8)] + [(90, None), (91, "")]
    shuffled = [w for _ in range(40) for w in rng.sample(words, 30)]
    got = {r.doc_id: r for r in lm_score.pseudo_likelihood(docs_of(spark, [*rows, (99, " ".join(shuffled))])).collect()}
    assert got[1].per_token > got[99].per_token
    assert got[90].n_tokens == got[91].n_tokens == 0 and got[90].per_token is None


def test_language_model_grows_with_the_vocabulary(spark):
    """Every word has a row of its own (but for hash collisions) and every position is a target."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(200))) for i in range(60)]
    rows += [(100, " ".join(f"x{i}" for i in range(3000))), (101, None)]
    words = [w for _, t in rows for w in (t or "").split()]
    bits, dense, keys, vectors = lm_score.fit(docs_of(spark, rows))
    assert (1 << bits) >= 1.9 * len(set(words)) and len(vectors) == len(keys)
    assert (keys < (1 << bits)).sum() > 0.75 * len(set(words))
    trainer = list(lm_score.training(bits)(iter([__import__("pandas").DataFrame({"text": [t for _, t in rows]})])))
    assert max(p["n"].max() for p in trainer) >= len(words)
    small = lm_score.fit(docs_of(spark, rows[:3]))
    assert len(small[2]) < len(keys) / 4
    got = {r.doc_id: r for r in lm_score.pseudo_likelihood(docs_of(spark, rows)).collect()}
    assert got[100].n_tokens == 3000 and got[101].per_token is None


def plain_log_likelihood(net, rows, words):
    """Word by word and digit by digit, with one row looked up at a time."""
    total, n = 0.0, len(words)
    for j, word in enumerate(words):
        beside = [words[j + s] if 0 <= j + s < n else net.border for s in lm_score.SIDES]
        near = sum(rows[int(w)] * g for w, g in zip(beside, net.dense["gates"]))
        h = np.tanh(near + net.dense["bias"])
        for i, (before, b, first) in enumerate(net.levels):
            z = net.dense[f"out{i}"] @ (h + rows[first + (int(word) >> (net.bits - before))]) + net._base(i)
            z = z.astype(float)
            digit = (int(word) >> (net.bits - before - b)) & ((1 << b) - 1)
            total += z[digit] - z.max() - np.log(np.exp(z - z.max()).sum())
    return total


def test_language_model_goes_to_its_parts_in_blocks(spark, monkeypatch):
    """Tasks hand on blocks of rows, not a row a word; each part gets the rows of its words."""
    monkeypatch.setattr(lm_score, "PART_WORDS", 700)
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", 900)
    rng = random.Random(5)
    texts = [" ".join([*(f"w{rng.randrange(40)}" for _ in range(60)), *(f"own{i}x{k}" for k in range(9))]) for i in range(40)]
    rows = [*enumerate(texts), (90, None), (91, ""), (92, "alone"), (93, texts[0])]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string")
    frames = list(lm_score.training(11, 3)(iter([pd.DataFrame({"text": texts})])))
    assert sum(len(f) for f in frames) == 4

    bits, _, path = lm_score.trained(docs)
    model = spark.read.parquet(path).collect()
    parts = {r.part for r in model}
    assert len(parts - {lm_score.EVERY}) > 2
    held = {p: [int(k) for r in model if r.part == p for k in np.cumsum(np.frombuffer(r["keys"], np.int64))] for p in parts}
    number = {w: int(lm_score.as_tokens(word_hashes(w), bits)[0]) for w in {w for t in texts for w in t.split()}}
    assert all(number[f"w{i}"] in held[lm_score.EVERY] for i in range(40))
    for i in (3, 30):
        here = [p for p in parts if number[f"own{i}x4"] in held[p]]
        assert len(here) == 1 and here[0] != lm_score.EVERY

    blocks = [lm_score._read_block(bytes(r["keys"]), bytes(r["rows"])) for r in model]
    net = lm_score.network(bits, *lm_score.joined(blocks))
    by_key = dict(zip(net.keys.tolist(), net.rows))
    for table in (docs, docs.repartition(5)):
        got = {r.doc_id: r for r in lm_score.pseudo_likelihood(table).collect()}
        assert len(got) == len(rows)
        assert got[0].per_token == pytest.approx(got[93].per_token)
        assert all(got[i].n_tokens == len((t or "").split()) for i, t in rows)
        assert got[90].per_token is None and got[90].log_likelihood == 0
        if table is docs:
            for i in (0, 17, 39, 92):
                want = plain_log_likelihood(net, by_key, lm_score.as_tokens(word_hashes(dict(rows)[i]), bits))
                assert got[i].log_likelihood == pytest.approx(want, rel=1e-4)
    assert lm_score.pseudo_likelihood(docs.limit(0)).collect() == []


def test_hashes_of_texts_equal_those_of_each_text():
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(200)) for _ in range(300)]
    texts += [None, "", " \n", "one", "x" * 70_000, prose(rng, 30_000), "last A\tb "]
    found = list(hashes_of_texts(texts))
    sizes = [len(word_hashes(t)) for t in texts]
    assert np.concatenate([n for _, n in found]).tolist() == sizes
    assert np.array_equal(np.concatenate([h for h, _ in found]), np.concatenate([word_hashes(t) for t in texts]))


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(600):
        words = prose(rng, 80).split()
        bad = i % 4 == 0
        for _ in range(5 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["vilebeast", "rottenfool", "scoundrelly"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs_of(spark, [*rows, (900, None), (None, "")]), labels).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs_of(spark, rows[:3]), labels.limit(0)).filter("score > 0").count() == 0


def test_toxic_samples_hold_the_whole_text():
    text = " ".join(f"vile{i:04d}" for i in range(400))
    keep = {w[:-1] for w in toxicity.windows_of(text)}
    samples = toxicity._samples(text, keep, dict.fromkeys(keep, 4))
    assert b"".join(samples) == b"".join(w[:-1] for w in toxicity.windows_of(text)) and len(samples) > 1


@pytest.mark.parametrize("length", [1, 7, 20])
def test_repeated_strings_of_shards(length):
    """Many shards of which some are one letter over and over, merged at once, against a count of all strings."""
    from collections import Counter

    from labelworks.llm import substrings

    rng = random.Random(length)
    shards = []
    for letters in ("a", "ab", "abcdefgh \u00e9\u65e5"):
        pool = "".join(rng.choices(letters, k=200))
        for _ in range(110):
            at = rng.randrange(150)
            shards.append((pool[at : at + rng.randint(length, length + 40)] + rng.choice(["", "x", "yz"])).encode())
    counts = Counter(s[i : i + length] for s in shards for i in range(len(s) - length + 1))
    want = [[i for i in range(len(s) - length + 1) if counts[s[i : i + length]] > 1] for s in shards]
    assert [x.tolist() for x in substrings.repeated_starts(shards, length)] == want
    _, _, starts = substrings._transforms(shards)
    at = 0
    for s in shards:
        assert starts[at : at + len(s) + 1].tolist() == sorted(range(len(s) + 1), key=lambda k: s[k:])
        at += len(s) + 1
