"""Operators on documents against brute force over a small corpus with odd rows."""

import collections
import hashlib
import re

from pyspark.sql import functions as F

from codecat.llm import decontamination, mixing, ngram_join, pii, quality_rules, substring_dedup, suffix_dedup
from codecat.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def test_substring_dedup(corpus, empty):
    rows, df = corpus
    texts = [words(r[1]) for r in rows]
    for length in (35, 4):
        seen = collections.Counter(tuple(w[i:i + length]) for w in texts for i in range(len(w) - length + 1))
        want = []
        for r, w in zip(rows, texts, strict=True):
            gone = set()
            for i in range(len(w) - length + 1):
                if seen[tuple(w[i:i + length])] > 1:
                    gone.update(range(i, i + length))
            want.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
        got = [(r["id"], r["n_words"], sum(s["hi"] - s["lo"] for s in r["spans"]), r["kept"])
               for r in substring_dedup.dedup_substrings(df, length=length).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_suffix_dedup(corpus, empty):
    rows, df = corpus
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((r[0], len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    got = [(r["id"], r["n_bytes"], sum(s["hi"] - s["lo"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
           for r in suffix_dedup.dedup_bytes(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_cover_meets_every_difference():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


def test_permutations_have_no_fixed_point():
    pairs = [[a, b] for a in range(26) for b in range(10)]
    moved = [tuple(pii.permuted(b"k", "t", p, [26, 10])) for p in pairs]
    assert len(set(moved)) == len(pairs) and all(tuple(p) != m for p, m in zip(pairs, moved, strict=True))


def shingles(text):
    w = [x for x in words((text or "").translate({c: c + 32 for c in range(65, 91)}))]
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, top = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def test_ngram_join(corpus, empty, monkeypatch):
    rows, df = corpus
    want = sorted(brute_components(rows), key=str)
    for part in (128, 1):  # groups whole, and cut into many parts
        monkeypatch.setattr(ngram_join, "PART", part)
        assert sorted(map(tuple, ngram_join.jaccard_components(df).collect()), key=str) == want
    assert ngram_join.jaccard_components(empty).count() == 0


def test_keep_one(corpus, empty):
    rows, df = corpus
    stays = [c for i, _, c in brute_components(rows) if i == c]
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == sorted(set(stays))
    assert ngram_join.keep_one(empty).count() == 0


def test_components(sp):
    edges = [(i, i + 1) for i in range(1, 60) if i % 10] + [(7, 7), (3, 55)] + [(1000, k) for k in range(900, 960)]
    got = {r["node"]: r["root"] for r in components(sp.createDataFrame(edges, "a long, b long")).collect()}
    assert got[55] == got[4] == 1 and got[20] == 11 and got[1000] == got[959] == 900


def test_quality_rules(corpus, empty):
    rows, df = corpus
    want = {}
    for r in rows:
        w, lines, repeat = words(r[1]), [x for x in (r[1] or "").split("\n") if words(x)], set()
        c = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        for i in range(len(w) - 2):
            if c[tuple(w[i:i + 3])] > 1:
                repeat |= {i, i + 1, i + 2}
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        want[(r[0], r[1])] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r[1] or "")),
                              len(lines) - len(set(lines)), len(repeat), failed)
    got = quality_rules.judge(df).collect()
    assert sorted((r["id"] or -1, *(r[c] for c in quality_rules.BASE), r["base_failed"]) for r in got) == sorted(
        (k[0] or -1, *v) for k, v in ((k, want[k]) for k in ((r[0], r[1]) for r in rows)))
    assert not any(r["kept"] and r["base_failed"] for r in got)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


def test_quality_posterior_is_em_fixed_point():
    import numpy as np
    clean, junk = 0b11000000000, 0b00000000011
    good = quality_rules.fit(np.array([clean, junk]), np.array([900.0, 100.0]))
    assert good[clean] > 0.99 and good[junk] < 0.01
    assert quality_rules.fit(np.array([], int), np.array([]))[clean] > 0.5


def test_mixing(corpus, empty):
    rows, df = corpus
    out = mixing.mix(df, n_shards=5).collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while True:  # reshare until none is above its cap
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = collections.Counter()
    for r in out:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
        got = sum(d["words"] for d in r["draws"])
        assert got <= 2 * r["size"] and all(0 <= d["shard"] < 5 for d in r["draws"])
        taken[r["source"]] += got
    assert all(taken[s] == round(target[s]) for s in names)
    again = mixing.mix(df.repartition(2), n_shards=5).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0
    full = mixing.mixture(df, n_shards=5)
    assert full.agg(F.sum("words")).first()[0] == sum(taken.values())
    assert all(len(words(r["text"])) == r["words"] for r in full.collect())


def test_splitting_tree_keeps_quotas(sp):
    quotas = sp.createDataFrame([(1, 1000), (2, 3), (3, 0), (4, 77)], "source_no int, quota long")
    rows = mixing.splitting_tree(quotas, 7).collect()
    for s, q in ((1, 1000), (2, 3), (4, 77)):
        held = sorted((r["first"], r["quota"]) for r in rows if r["source_no"] == s)
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and sum(n for _, n in held) == q
    per = collections.Counter()
    for r in rows:
        per[r["shard"]] += r["quota"]
    assert max(per.values()) - min(per.values()) <= 7


def test_decontamination(sp, corpus, empty):
    _, df = corpus
    item = " ".join(f"q{i}" for i in range(30))
    changed = item.replace("q5 ", "zz ").replace("q14 ", "yy ")
    docs = df.unionByName(sp.createDataFrame(
        [(900, f"before words {item} after"), (901, f"x {changed.upper()}, y"), (902, " ".join(item.split()[:6]) + " else"),
         (903, " ".join(f"q{i}" if i % 2 else "n" for i in range(30))), (904, item)], "doc_id long, text string"), allowMissingColumns=True)
    items = sp.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (1, item)], "item_id long, text string")
    got = {(r["id"], r["item"], r["n_equal"]) for r in decontamination.overlaps(docs, items).collect()}
    assert got == {(900, 1, 30), (901, 1, 28), (904, 1, 30)}
    clean = decontamination.without_leaks(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 3
    assert decontamination.overlaps(empty, items).count() == 0 and decontamination.overlaps(docs, items.where("false")).count() == 0


def test_pii(sp, corpus, empty):
    texts = [(1, "Write to Anna Schmidt, anna.s@Example.com or +1 (499) 555-6503."), (2, "ANNA.S@EXAMPLE.COM 10.0.0.1 8.8.8.8 +14995556503"),
             (3, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and 4111 1111 1111 1111"), (4, None), (5, ""), (6, "nothing here, at all")]
    docs = sp.createDataFrame(texts, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.with_surrogates(docs, entities_col="m").collect()}
    assert rows[4]["text"] is None and rows[5]["text"] == "" and rows[6]["text"] == texts[5][1]
    joined = " ".join(r["text"] or "" for r in rows.values()).lower()
    for secret in ("anna", "schmidt", "555-6503", "4995556503", "10.0.0.1", "8.8.8.8", "24be6443", "4111 1111 1111"):
        assert secret not in joined
    mail = re.search(r"\S+@\S+\.com", rows[1]["text"])[0]
    assert mail.lower() in rows[2]["text"].lower() and rows[2]["text"].split()[1].startswith("10.")
    phone = re.sub(r"\D", "", re.search(r"\+.*\d", rows[1]["text"])[0])
    assert rows[2]["text"].endswith(phone)
    card = [int(c) for c in re.search(r"\d{4} \d{4} \d{4} \d{4}", rows[3]["text"])[0] if c.isdigit()]
    assert pii._luhn(card) and pii.find(rows[1]["text"])[0][2] == "name"
    told = pii.with_surrogates(docs, entities_col="m").select(F.explode("m").alias("m")).select("m.*")
    assert pii.collisions(told).count() == 0
    assert pii.with_surrogates(empty).count() == 0 and pii.with_surrogates(corpus[1]).columns == corpus[1].columns
