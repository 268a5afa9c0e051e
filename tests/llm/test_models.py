"""Text, token, page and archive operators against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, html_extract, mixing, quality_classifier, quality_rules, queries, simhash, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# rules


def base_brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(cover)


def test_rules_base_counts(spark, docs_of, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 5000] + [(50, "a b c a b c d\nx\nx\n#*$%&|<> é中"), (51, "a a a a"), (52, "\n\n \n"), (53, "a b c")]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert [r.doc_id for r in quality_rules.trusted_ids(labels).collect()] == [2]
    got = quality_rules.quality_rules(docs_of(rows, extra=True), labels).select("doc_id", "quality.*").collect()
    want = sorted(((i, *base_brute(t)) for i, t in rows), key=str)
    assert sorted(((g[0], *g[1:6]) for g in got), key=str) == want
    assert all(g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words) and (not g.kept or not g.base_failed) for g in got)
    assert quality_rules.quality_rules(docs_of([]), labels.limit(0)).count() == 0


def test_rules_ratio_brute(spark, docs_of):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(60 + i))) for i in range(12)]
    trusted = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    table = quality_rules.WordHashes()
    raw, good = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for i, t in rows:
        for g in quality_rules.grams(table.of(t.encode().split())):
            raw[g] += 1
            good[g] += i < 5
    llr = np.log((good + 5) / (raw * good.sum() / raw.sum() + 5))
    assert np.allclose(quality_rules.fit(docs_of(rows), trusted), llr)
    for r in quality_rules.score(docs_of(rows), llr).select("text", "quality.llr", "quality.kept", "quality.base_failed").collect():
        mean = np.mean([llr[g] for g in quality_rules.grams(table.of(r.text.encode().split()))])
        assert abs(r.llr - mean) < 1e-9 and r.kept == (not r.base_failed and mean >= quality_rules.THRESHOLD)


def test_rules_separate_labels(spark):
    got = queries.op10_quality_rules(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    able = got[~got.base_failed]
    assert able[able.quality == 1].kept.mean() == 1 and able[able.quality == 0].kept.mean() < 0.1


# classifier


def test_classifier_held_out(spark):
    got = queries.op9_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    test = got[got.held_out].merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    good, bad = test[test.quality == 1].score.to_numpy(), test[test.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97 and (test.predicted == test.quality).mean() > 0.95


def test_classifier_odd_rows(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 0, 0), (14, 1, 0), (16, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_classifier(docs_of(odd_rows, extra=True), labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in quality_classifier.quality_classifier(docs_of(odd_rows), labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_classifier(docs_of([]), labels).count() == 0


def test_isotonic():
    xs, ys = quality_classifier.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 2, 1, 4]), np.array([2.0, 2, 2, 4]))
    assert list(xs) == [1, 2.5, 4] and list(ys) == [0, 0.75, 1]


# tokens


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_equals_library(spark, docs_of, odd_rows, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    parts = ["a", "b", "the", "é", "ß", "  ", "\n", "1", "#", "中", "😀", "ing", "tion", "'s", " ", " ", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.choice((3, 20, 200)))) for _ in range(300)]
    texts += ["a" * 20_001, "ab" * 9_000, "".join(r.choice("abcdeé") for _ in range(20_000)), " " * 9_000, "thethe" * 3_000]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + odd_rows
    got = byte_bpe.byte_bpe(docs_of(rows, extra=True), ranks, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g.token_ids == library.encode_ordinary(g.text or "") and bytes(g.decoded) == (g.text or "").encode()
    assert byte_bpe.byte_bpe(docs_of([]), ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_join_is_associative(ranks):
    codec, r = byte_bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(5)
    for _ in range(300):
        raw = "".join(r.choice("aehinorstё") for _ in range(r.randint(2, 60))).encode()
        cut = r.randrange(len(raw) + 1)
        assert codec.join(codec.merge(raw[:cut]), codec.merge(raw[cut:])) == codec.merge(raw) == codec.tree(raw)


# mix


def test_mix(docs_of):
    r = random.Random(1)
    rows = [(i, "w " * r.choice((0, 1, 2, 3, 50, 51, 400)), r.choice(("a", "b", "c", "d", None))) for i in range(400)] + [(1000 + i, "same text here", "hot") for i in range(300)]
    got = mixing.mix(docs_of(rows, extra=True)).select("doc_id", "source", "size", "source_size", "target", "taken").toPandas()
    assert len(got) == len(rows) and (got["size"] == got.doc_id.map({i: len(t.split()) for i, t, _ in rows})).all()
    assert ((got.taken == 0) | (got.taken == got["size"]) | (got.taken == 2 * got["size"])).all()
    per = got.groupby("source", dropna=False).agg(own=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    per = per.loc[["a", "b", "c", "d", "hot", np.nan]]
    assert (per.own == per.said).all() and ((per.taken - per.target).abs() <= 3).all()
    weight, cap, budget = np.array([5.0, 2, 1, 5, 2, 1]), 2.0 * per.own.to_numpy(), 1.5 * per.own.sum()
    free, want = np.ones(6, bool), np.zeros(6)
    while True:  # reshare the excess until none is above its cap
        want = np.where(free, (budget - cap[~free].sum()) * weight / max(weight[free].sum(), 1), cap)
        if not (over := free & (want > cap)).any():
            break
        free &= ~over
    assert np.allclose(per.target, want)
    again = mixing.mix(docs_of(rows[::-1])).select("doc_id", "taken").toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_mix_repeated_rows(docs_of):
    rows = [(1, " ".join(f"w{i}" for i in range(10)), "a")] * 700 + [(i, "x y z", "b") for i in range(50)] + [(None, "p q", "b")] * 40
    mixed = mixing.mix(docs_of(rows, extra=True).withColumns({c: F.lit(c) for c in ("_s", "_u", "_c", "_cut", "_spare", "row")}))
    got = mixed.toPandas()
    assert len(got) == len(rows)
    for c in ("_s", "_u", "_c", "_cut", "_spare", "row"):
        assert set(got[c]) == {c}
    for _, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max()
        assert part["source_size"].iloc[0] == part["size"].sum()
    assert ((got["taken"] == 0) | (got["taken"] % got["size"] == 0)).all() and (got["taken"] <= 2 * got["size"]).all()


def test_mix_odd_rows(docs_of, odd_rows):
    got = mixing.mix(docs_of(odd_rows, extra=True)).collect()
    assert len(got) == len(odd_rows) and all(0 <= g.taken <= 2 * g["size"] for g in got)
    assert mixing.mix(docs_of([])).count() == 0
    assert mixing.mix(docs_of([(1, None), (2, "")])).count() == 2


def test_fit_budget_is_best():
    r = random.Random(2)
    for _ in range(60):
        size = np.array(sorted(r.sample(range(1, 40), r.randint(1, 6))))
        count = np.array([r.randint(1, 4) for _ in size])
        total = int((size * count).sum())
        target = r.uniform(0, 2 * total)
        copies, pick = mixing.fit_budget(size, count, target)
        assert (pick >= 0).all() and (pick <= count).all() and copies in (0, 1, 2)
        goal = int(target + 0.5)
        assert goal - max(size) < copies * total + (size * pick).sum() <= goal


# fingerprints


def test_simhash_rows(docs_of, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (14, 16, None)]  # one row for each doc_id: the order is certain
    got = {g.doc_id: g for g in simhash.with_next(docs_of(rows, extra=True)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    table = simhash.WordHashes()
    mark = lambda t: simhash.fingerprint(t.encode().split(), table)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        new = t[: len(t) - half] + n[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[i].fingerprint == mark(t).hex() and got[i].edited_fingerprint == mark(new).hex()
        assert got[i].near_edited == simhash.likeness(mark(t), mark(new)) and got[i].near_next == simhash.likeness(mark(t), mark(n))
    assert len(simhash.with_next(docs_of(odd_rows)).collect()) == len(odd_rows)
    assert simhash.with_next(docs_of([])).count() == 0 and simhash.with_next(docs_of([(1, "a b")])).first().near_next == 1.0


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_neighbours(spark, radius):
    r = random.Random(radius)
    base = [r.getrandbits(128) for _ in range(20)]
    values = set(base)
    for b in base:
        for _ in range(12):
            v = b
            for _ in range(r.randint(1, 9)):
                v ^= 1 << r.randrange(128)
            values.add(v)
    hexes = [f"{v:032x}" for v in values]
    want = {(a, b, d) for a in hexes for b in hexes if a < b and (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius}
    df = spark.createDataFrame([(h,) for h in [*hexes, hexes[0], None]], "fingerprint string")
    got = [tuple(x) for x in simhash.neighbours(df, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


# archives


def archive(n=20):
    payload = [b"hello %d " % i * 100 for i in range(n)]
    recs = [warc.record(i, f"http://x/{i}", p, warc.sha1(p), None) for i, p in enumerate(payload)]
    return b"".join(warc.member(x) if i % 3 else x for i, x in enumerate(recs))


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a b/\n", "same"), (2, None, "same"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 300_000), (None, "u", "same"), (8, "u", "é中😀\r\n\r\nWARC/1.1\r\n"), (2, None, "same"), (9, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.resolved(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert len(got) == len(rows)
    least = {"same": 2, "": 5}
    for g in got:
        html = next(h or "" for p, _, h in rows if p == g.page_id)
        raw = html.encode()
        first = least.get(html)
        is_copy = first is not None and g.page_id != first
        assert (g.record_type, g.refers_to) == (("revisit", first) if is_copy else ("response", None))
        assert g.payload_bytes == len(raw) and g.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert bytes(g.payload) == (b"" if is_copy else raw)
    for f in (tmp_path / "w").glob("part*"):
        whole = f.read_bytes()
        engine_out = b""
        while whole:  # a plain gzip reader agrees
            d = zlib.decompressobj(31)
            engine_out += d.decompress(whole)
            whole = d.unused_data
        assert engine_out.startswith(b"WARC/1.1\r\n") or not engine_out
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_salvage_accounts_for_every_byte():
    whole, r, payloads = archive(), random.Random(1), {b"hello %d " % i * 100 for i in range(20)}
    assert [x["page_id"] for x in warc.salvage(whole)] == list(range(20))
    for _ in range(200):
        bad = bytearray(whole)
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(bad))
            if r.random() < 0.5:
                bad[at] ^= 1 << r.randrange(8)
            else:
                del bad[at : at + r.randrange(1, 400)]
        out = list(warc.salvage(bytes(bad)))
        assert sum({x["offset"]: x["length"] for x in out}.values()) == len(bad)
        found = [x for x in out if x["kind"] == "record"]
        assert len(found) >= 13 and {x["payload"] for x in found} <= payloads  # headers have no digest of their own
    gaps = [x for x in warc.salvage(b"junk" + whole[: len(whole) - 5]) if x["kind"] == "gap"]
    assert gaps[0]["offset"] == 0 and gaps[0]["length"] == 4 and len(gaps) == 2


def test_salvage_inside_members():
    payload = [random.Random(i).randbytes(3000) for i in range(12)]
    recs = [warc.record(i, f"http://x/{i}", x, warc.sha1(x), None) for i, x in enumerate(payload)]
    ids = lambda raw: [x["page_id"] for x in warc.salvage(raw) if x["kind"] == "record"]
    bad = bytearray(b"".join(recs))
    at = sum(map(len, recs[:5]))
    bad[at + len(recs[5]) - 100] ^= 1  # one damaged record in a member without a gzip error
    out = list(warc.salvage(warc.member(bytes(bad)) + warc.member(recs[0])))
    assert [x["page_id"] for x in out if x["kind"] == "record"] == [i for i in range(12) if i != 5] + [0]
    assert [(x["inner_offset"], x["inner_length"], x["offset"], x["reason"]) for x in out if x["kind"] == "gap"] == [(at, len(recs[5]), 0, "block digest")]
    whole = warc.member(b"".join(recs))
    assert ids(whole[:-3]) == list(range(12))  # only the gzip trailer is cut
    assert ids(whole[:-5] + bytes([whole[-5] ^ 1]) + whole[-4:]) == list(range(12))  # a wrong CRC
    cut = whole[: len(whole) // 2]
    got = ids(cut)
    assert got == list(range(len(got))) and 4 <= len(got) <= 6
    after = list(warc.salvage(cut + whole + cut))  # a damaged member before a good one, and another behind it
    assert [x["page_id"] for x in after if x["kind"] == "record"][len(got) :] == [*range(12), *got]
    assert sum({x["offset"]: x["length"] for x in after}.values()) == 2 * len(cut) + len(whole)
    assert all(x["payload"] == payload[x["page_id"]] for x in after if x["kind"] == "record")


# pages


@pytest.mark.parametrize("nameless, most", [(0, 0.005), (1, 0.03)])
def test_html_held_out_pages(nameless, most):
    field, wrong, total = html_extract.default_field(), 0, 0
    for page in html_extract.labelled_pages(300, 99, nameless):
        found, labels = html_extract.parsed(page)
        if found:
            got = field.decode(field.scores(found))
            wrong, total = wrong + sum(a != b for a, b in zip(got, labels)), total + len(labels)
    assert total > 5000 and wrong < most * total


def test_html_by_another_hand():
    """A page whose names mean nothing, written apart from the generator."""
    page = """<html><body><div class=x1><a href=/>Start</a> <a href=/b>Blog</a> <a href=/c>Contact</a></div>
    <div class=zq><h1>How bread rises</h1><p>Yeast eats sugar and gives off gas, and the gas is held by the dough for as long as it is strong enough.</p>
    <p>Knead it <button>Share this</button> for ten minutes; then let it rest <select><option>1 h<option>2 h</select> in a warm place until it has doubled.</p><p>Bake.</p></div>
    <div class=k7><h3>You may also like</h3><a href=1>Ten soups for winter</a> <a href=2>What to do with old rice</a></div>
    <div class=p0>This site uses cookies. Accept our privacy policy.</div></body></html>"""
    got = html_extract.default_field().extract(page)
    assert got == "How bread rises\nYeast eats sugar and gives off gas, and the gas is held by the dough for as long as it is strong enough.\nKnead it for ten minutes; then let it rest in a warm place until it has doubled.\nBake."


def test_html_pages(spark):
    head = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
    foot = "<footer>&copy; x. Terms.</footer></body></html>"
    body = "<article><h1>Big &amp; small</h1><p>First   line<br>goes\n on &lt;here&gt;.<p><b>Second</b> one, quite a bit longer than the first one was.</p><div class='ad'>Buy now.</div></article>"
    rows = [(1, "u", head + body + foot), (2, "u", None), (3, None, ""), (4, "u", "plain"), (None, "u", head + body[:120]), (5, "u", "<" * 3000), (6, "u", head + "<article>" + "<p>Word word word.</p>" * 5000 + "</article>"), (1, "u", head + body + foot)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    first = [g.text for g in got if g.page_id == 1]
    assert first == ["Big & small\nFirst line goes on <here>.\nSecond one, quite a bit longer than the first one was."] * 2
    by = {g.page_id: g.text for g in got}
    assert by[2] == by[3] == "" and by[6] == "\n".join(["Word word word."] * 5000) and by[None].startswith("Big & small\nFirst line goes")
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_viterbi_is_best():
    r = np.random.default_rng(1)
    for _ in range(50):
        f = html_extract.Field(steps=r.normal(size=(2, 2)), start=r.normal(size=2))
        scores = r.normal(size=7).tolist()
        value = lambda y: f.start[y[0]] + sum(s * k for s, k in zip(scores, y)) + sum(f.steps[a, b] for a, b in zip(y, y[1:]))
        best = max(([(n >> i) & 1 for i in range(7)] for n in range(128)), key=value)
        assert f.decode(scores) == best
