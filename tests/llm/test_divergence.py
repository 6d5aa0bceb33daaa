import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecat.llm import divergence as dv


def brute(rows, min_docs, top):
    """The contract in plain Python; rows (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
                       for w in re.findall("[A-Za-z\x80-\U0010ffff]+", t)]
    out = []
    for lang in {r[1] for r in rows}:
        df, count, groups = Counter(), Counter(), {}
        for text, la, source in rows:
            if la == lang:
                ws = terms(text)
                df.update(set(ws))
                count.update(ws)
                groups.setdefault(source, Counter()).update(ws)
        kept = [t for t in df if df[t] >= min_docs]
        v, total = len(kept), sum(count[t] for t in kept)
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * v)
        q = {t: share(count[t], total) for t in kept}
        p = {}
        for s, c in groups.items():
            n = sum(c[t] for t in kept)
            p[s] = {t: share(c[t], n) for t in kept}
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            found = [(p[s][t] - q[t], t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, len(pairs)), ("term", found, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items[:limit])]
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("ab", "É", "漢") for b in "stuvwxyzq" for c in ("", "x", "ö")]
    out = []
    for _ in range(300):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "S"])
        bias = len(source or "") * 7
        out.append((" ".join(rng.choice(words[bias: bias + 40]) + rng.choice(["", ".", "1"]) for _ in range(rng.randint(0, 30))), lang, source))
    out += [(None, "en", "empty"), ("", "xx", "a"), ("", "xx", "b"), ("only one", "yy", "z"), *out[:5]]
    return out


@pytest.mark.parametrize("min_docs, top", [(3, 5), (20, 2), (1, 1000)])
def test_audit_equals_brute_force(sp, rows, min_docs, top):
    docs = sp.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, rank int, value int").repartition(6)
    got = dv.audit(docs, min_docs=min_docs, top=top)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, min_docs, top)


def test_skyband_equals_all_comparisons():
    rng = np.random.default_rng(2)
    for k in (1, 2, 5):
        for _ in range(40):
            n = int(rng.integers(0, 60))
            g, low, term = rng.integers(0, 6, n), rng.integers(0, 6, n), rng.permutation(n)
            above = (g[None] >= g[:, None]) & (low[None] <= low[:, None]) & (term[None] < term[:, None])
            assert sorted(dv.skyband(g, low, term, k).tolist()) == np.flatnonzero(above.sum(axis=1) < k).tolist()


def test_partitions_thin_out_and_lose_no_winner(sp, monkeypatch):
    monkeypatch.setattr(dv, "HELD_ROWS", 16)
    rng = random.Random(1)
    data = [("l", "s", f"t{i}", rng.randint(1, 40), rng.randint(40, 80)) for i in range(3000)]
    rows = sp.createDataFrame(data, "lang string, source string, term string, n long, l long").withColumn("value", 10 * F.col("n") - F.col("l"))
    left = dv.partial_skybands(rows.repartition(4), 3)
    assert left.count() < 1500
    want = sorted(data, key=lambda r: (-(10 * r[3] - r[4]), r[2].encode()))[:3]
    got = dv.standing_out(rows.repartition(4), 3).orderBy("rank").collect()
    assert [r.item for r in got] == [w[2] for w in want]


def test_large_counts_stay_exact(sp):
    df = sp.range(1).select(dv._share(F.lit(9 * 10**15), F.lit(10**16 + 3), F.lit(7)).alias("p"),
                            dv._share(F.lit(0), F.lit(0), F.lit(0)).alias("none"))
    assert tuple(df.first()) == (1 + 10**9 * (9 * 10**15 + 5) // (10**16 + 3 + 35), None)


def test_empty_table(sp):
    assert dv.audit(sp.createDataFrame([], "text string, lang string, source string")).count() == 0
