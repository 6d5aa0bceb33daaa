"""The pipeline, stage by stage, against plain Python: votes and EM, all pairs, all alignments, planted secrets, water-filled targets."""

import collections
import math
import random
import re

import corpus_pipeline
import pytest
from test_documents import brute_components, words

from codecat.llm import quality_rules as Q

RULES_GOOD = [good for _, good in Q.RULES]
MAIL = "anna.s@example.com"


def votes(text):
    """Which rules speak up on a text, in the order of the rules."""
    w, n = words(text), max(len(words(text)), 1)
    letter = lambda c: ("a" <= c <= "z") or ("A" <= c <= "Z") or c > "\x7f"
    ends = [x[-1] in ".!?" for x in w]
    plain = sum(any(map(letter, x)) and all(map(letter, x[:-1] if e or x[-1] == "," else x)) for x, e in zip(w, ends, strict=True))
    lines = [x for x in text.split("\n") if words(x)]
    dup = 100 * (len(lines) - len(set(lines))) / max(len(lines), 1)
    triples = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    again = len({i + k for i in range(len(w) - 2) if triples[tuple(w[i:i + 3])] > 1 for k in range(3)})
    symbols = 100 * sum(any(c in "#*$%&|<>" for c in x) for x in w) / n
    upper = 100 * sum("A" <= c <= "Z" for c in text) / max(sum(c.isascii() and c.isalpha() for c in text), 1)
    length, repeat = sum(map(len, w)) / n, 100 * again / n
    said = (100 * sum(c in "#*$%&|<>" for c in text) / n >= 10, symbols >= 10, dup >= 30, repeat >= 30, len(set(w)) < 0.5 * n ** 0.75,
            upper >= 40, 100 * sum(x.endswith("!!") for x in w) / n >= 20, 100 * sum(not any(map(letter, x)) for x in w) / n >= 25,
            length < 2 or length > 15, 100 * plain / n >= 90 and repeat < 25,
            1 <= 100 * sum(ends) / n <= 40 and dup < 20 and upper < 30 and symbols < 5)
    return said, len(w) < 50 or 2 * again > len(w)


def posterior(patterns):
    """P(good) by pattern, by expectation-maximisation over single documents."""
    n, rules = len(patterns), range(len(RULES_GOOD))
    hold, share = Q.BELIEF_SHARE * n + 1, Q.PRIOR
    belief = {(g, r): Q.RIGHT if RULES_GOOD[r] == g else Q.WRONG for g in (False, True) for r in rules}
    rate = dict(belief)

    def good(p):
        like = {g: (share if g else 1 - share) * math.prod(rate[g, r] if p[r] else 1 - rate[g, r] for r in rules) for g in (False, True)}
        return like[True] / (like[True] + like[False])
    for _ in range(200):
        by = {p: good(p) for p in set(patterns)}
        mass = {g: sum(by[p] if g else 1 - by[p] for p in patterns) for g in (False, True)}
        new = {(g, r): (sum((by[p] if g else 1 - by[p]) for p in patterns if p[r]) + belief[g, r] * hold / 2) / (mass[g] + hold / 2)
               for g in (False, True) for r in rules}
        for r in rules:  # never rarer on its own class than on the other
            new[not RULES_GOOD[r], r] = min(new[True, r], new[False, r])
        rate, share = new, (mass[True] + Q.PRIOR * hold) / (n + hold)
    return {p: good(p) for p in set(patterns)}


def leaks(text, item):
    """Whether some alignment agrees with the item in 84 of 100 places of a window of 13, or of the whole item."""
    w, x = re.split(r"[\W_]+", text.lower()), [t for t in re.split(r"[\W_]+", item.lower()) if t]
    size = min(len(x), 13)
    for shift in range(-len(x), len(w)):
        same = [0 <= shift + j < len(w) and w[shift + j] == x[j] for j in range(len(x))]
        if any(100 * sum(same[i:i + size]) >= 84 * size for i in range(len(x) - size + 1)) and len(x) >= 8:
            return True
    return False


@pytest.fixture(scope="module")
def tables(sp, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(900)]

    def clean(n):
        return "\n".join(" ".join(rng.choice(vocabulary) for _ in range(9)).capitalize() + "." for _ in range(n))
    rows = [(i, clean(rng.randint(7, 14))) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(["$", "##", "|", "A1%", "BUY!!", "<b>", rng.choice(vocabulary)]) for _ in range(90))) for i in range(12)]
    rows += [(150, "too short"), (151, None), (152, ""), (153, "one two three four five " * 30)]
    rows += [(200 + i, rows[i][1]) for i in range(4)] + [(210 + i, rows[5][1].replace(words(rows[5][1])[-1], f"w{i}")) for i in range(3)]
    item, other = " ".join(rng.choice(vocabulary) for _ in range(30)), " ".join(rng.choice(vocabulary) for _ in range(9))
    swapped = item.split()
    swapped[4] = swapped[13] = "changed"
    rows += [(300, f"{clean(8)}\n{item}."), (301, f"{clean(8)}\n{' '.join(swapped).upper()}, and so on."), (302, f"{clean(8)}\n{other}."),
             (303, f"{clean(8)}\n{' '.join(item.split()[:6])}.")]
    rows += [(400 + i, f"{clean(8)}\nWrite to {MAIL if i % 2 else MAIL.upper()} soon.") for i in range(4)]
    rows += [(500, rows[7][1]), (500, clean(9)), (None, clean(9))]
    data = [(i, t, "en", None if i == 8 else f"s{(i or 0) % 4}", len(t or "")) for i, t in rows]
    where = tmp_path_factory.mktemp("pipeline")
    sp.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int").repartition(4).write.parquet(f"{where}/documents.parquet")
    sp.createDataFrame([(1, item), (1, other), (2, None), (3, "too few words")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), [item, other, "too few words"]


def as_rows(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)


def test_every_stage(sp, tables):
    where, items = tables
    docs = sp.read.parquet(f"{where}/documents.parquet")
    steps, now = dict(corpus_pipeline.STAGES), as_rows(docs)

    def step(name):
        nonlocal docs
        docs = corpus_pipeline.stage(steps[name](sp, docs, where), "test")
        return as_rows(docs)

    said = [votes(t or "") for _, t, _ in now]
    p_good = posterior([v for v, failed in said if not failed])
    now = [r for r, (v, failed) in zip(now, said, strict=True) if not failed and p_good[v] >= Q.THRESHOLD]
    kept = {r[0] for r in now}
    assert kept >= {*range(60), 300, 301, 302, 303, 400} and not kept & {*range(100, 112), 150, 151, 152, 153}
    assert step("quality rules") == now

    groups = collections.defaultdict(list)
    for r, (_, _, component) in zip(now, brute_components([(n, r[1]) for n, r in enumerate(now)]), strict=True):
        groups[component].append(r)
    got = step("n-gram Jaccard join")
    assert len(got) == len(groups) < len(now) and all(sum(r in got for r in set(g)) == 1 for g in groups.values())
    assert all(next(r for r in g if r in got)[0] == min(r[0] for r in g if r[0] is not None) for g in groups.values() if any(r[0] is not None for r in g))

    now = [r for r in got if not any(leaks(r[1], x) for x in items)]
    assert {r[0] for r in got} - {r[0] for r in now} == {300, 301, 302}
    assert step("benchmark decontamination") == now

    got = step("PII surrogates")
    before = {(r[0], r[2]): r[1] for r in now}
    assert len(got) == len(now) and all(t == before[i, s] for i, t, s in got if i is None or i < 400 or i >= 500)
    mails = {re.search(r"\S+@\S+", t)[0].lower() for i, t, s in got if i is not None and 400 <= i < 500}
    assert len(mails) == 1 and MAIL not in mails
    assert all(re.sub(r"\S+@\S+", "", t) == re.sub(r"\S+@\S+", "", before[i, s]) for i, t, s in got)
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    size = collections.Counter()
    for _, t, s in got:
        size[s] += len(words(t))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target = {}
    while True:  # sources above their cap stop there, the rest is shared again
        free = [s for s in size if s not in target]
        level = (1.5 * sum(size.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        target |= {s: 2.0 * size[s] if over else level * weight[s] for s in over or free}
        if not over:
            break
    mixed = steps["mixing"](sp, docs, where).collect()
    whole, cut, taken = collections.Counter(), collections.Counter(), collections.Counter()
    texts = collections.defaultdict(list)
    for i, t, s in got:
        texts[i, s].append(t)
    for r in mixed:
        full = next((t for t in texts[r["doc_id"], r["source"]] if t == r["text"]), None)
        taken[r["source"]] += len(words(r["text"]))
        if full is not None:
            whole[r["doc_id"], r["source"], full] += 1
        else:
            assert any(words(t)[: r["words"]] == r["text"].split(" ") for t in texts[r["doc_id"], r["source"]])
            cut[r["source"]] += 1
    assert dict(taken) == {s: math.floor(target[s] + 0.5) for s in size}
    assert max(cut.values(), default=0) <= 1
    for i, t, s in got:
        passes = math.floor(target[s] + 0.5) // size[s]
        assert passes <= whole[i, s, t] <= min(passes + 1, 2)
    final = corpus_pipeline.run(sp, where)
    assert sorted(map(str, final.collect())) == sorted(map(str, mixed))
