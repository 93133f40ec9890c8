"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import chat, jaccard, lattice, mixing, packing, privacy, quality, sharding, suffix_tree, tokens
from quillon.llm.common import Bloom, components, shared_folder
from quillon.llm.entry import TOKENIZERS

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, part int, row string, term string, fp bigint"


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    near = [b.replace(" ", "  ", 1) + " tail" for b in base[:10]]
    odd = [None, "", " \n\t", "one", "ONE", "one two", "é ü ß 日本 İx Σς", "x" * 5000, "a b c", "word " * 5000, "mail bob@x.example.org now, call +1 (663) 555-6869 or 10.0.0.255, 4465758382889437", "<|endoftext|> #*$ | |"]
    return base + near + odd + base[:5] + [base[0]] * 20


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0" if i % 3 else None, 1, "r", "t", 5) for i, t in enumerate(texts())]
    rows += [(None, "null id", None, "s", 1, "r", "t", 5), (3, "same id, other text", "de", "s", 1, "r", "t", 5), rows[7], rows[7]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def data(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def words(text):
    return (text or "").encode().split()


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def test_token_counts(docs, empty, tmp_path):
    path = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    prefixes = tokens.pieces(path)

    def plain(word):
        score, count = [0.0], [0]
        for end in range(1, len(word) + 1):
            s, n = max(((score[s] + prefixes[word[s:end]], -(count[s] + 1)) for s in range(end) if prefixes.get(word[s:end], 1) <= 0))
            score.append(s)
            count.append(-n)
        return count[-1]

    short = docs.where("text is null or length(text) < 3000")
    got = sorted((r.doc_id, r.n_words, r.n_tokens) for r in tokens.counted(short, path).where("doc_id is not null").collect())
    assert got == sorted((d, len(words(t)), sum(plain(b" " + w) for w in words(t))) for d, t in data(short) if d is not None)
    assert tokens.counted(empty, path).count() == 0
    toy = tokens.with_prefixes({b"a": -1.0, b"ab": -1.5, b"b": -1.0})
    assert dict(tokens.forward(sorted([b"ab", b"aab", b"abz"]), toy)) == {b"ab": 1, b"aab": 2, b"abz": 2}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/word_bpe_49k.json"
    whole = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    want = Counter()
    for d, t in data(docs):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[d, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = list(itertools.accumulate(n for _, n in sorted(b)))
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert packing.pack(empty, path).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for capacity in (7, 32, 100):
        sizes = [rng.randint(1, capacity) for _ in range(400)]
        room = []
        for s in sorted(sizes, reverse=True):
            fit = [(r, i) for i, r in enumerate(room) if r >= s]
            if fit:
                room[min(fit)[1]] -= s
            else:
                room.append(capacity - s)
        steps = packing.plan(Counter(sizes), capacity)
        used, first = defaultdict(list), Counter()
        for length, begin, per, at, offset in zip(*(steps[k].tolist() for k in ("length", "first", "per", "bin", "offset")), strict=True):
            later = [x for n, x in zip(steps["length"].tolist(), steps["first"].tolist(), strict=True) if n == length and x > begin]
            for i in range(begin, min([*later, Counter(sizes)[length]])):
                used[at + (i - begin) // per].append((offset + (i - begin) % per * length, length))
                first[length] += 1
        assert first == Counter(sizes) and sorted(capacity - sum(n for _, n in b) for b in used.values()) == sorted(room)
        assert all([o for o, _ in sorted(b)] == [0, *list(itertools.accumulate(n for _, n in sorted(b)))[:-1]] for b in used.values())


def test_suffix_tree(docs, empty):
    got = suffix_tree.score(docs, head=5, memo=50).collect()
    rows = data(docs)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    toks = [(d, [w.translate(LOWER) for w in words(t)] + [b"\n"]) for d, t in rows]
    count = Counter(w for d, ts in toks if not held(d) for w in ts)
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if d is None else d, held(d), len(ts), sum(count[w] > 0 for w in ts), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), 6)) for d, ts in toks)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    after = brute_tree([ts for d, ts in toks if not held(d)])
    total = lambda ts: sum(math.log10(after(w[:-1], w[-1])) for w in byte_windows(ts))
    scores = sorted(round(total(ts), 5) for d, ts in toks)
    assert sorted(round(r.score, 5) for r in got) == scores
    for head, memo in ((10**6, 10**6), (0, 0)):
        assert sorted(round(r.score, 5) for r in suffix_tree.score(docs, head=head, memo=memo).collect()) == scores
    assert suffix_tree.score(empty).count() == 0


def test_suffix_tree_beats_the_base_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = suffix_tree.score(docs).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]


def byte_windows(tokens):
    row = b"\n" * suffix_tree.DEPTH + b" ".join(tokens[:-1]) + b"\n"
    return [row[i : i + suffix_tree.DEPTH + 1] for i in range(len(row) - suffix_tree.DEPTH)]


def brute_tree(texts):
    """P(symbol | context) of the suffix tree, from counts of each suffix's next symbols."""
    nexts = defaultdict(Counter)
    for t in texts:
        for w in byte_windows(t):
            for k in range(suffix_tree.DEPTH + 1):
                nexts[w[suffix_tree.DEPTH - k : -1]][w[-1]] += 1

    def retained(u):
        seen, total, below = nexts[u], sum(nexts[u].values()), nexts[u[1:]]
        gain = sum(n * math.log(n / total / (below[s] / sum(below.values()))) for s, n in seen.items())
        return total >= suffix_tree.SUPPORT and gain >= suffix_tree.GAIN_PER_SYMBOL * len(seen)

    kept = {u for u in list(nexts) if u and retained(u)}
    assert len({len(u) for u in kept}) == suffix_tree.DEPTH

    def after(u, symbol):
        if not u:
            return (nexts[u][symbol] + 0.5) / (sum(nexts[u].values()) + 128)
        if u not in kept:
            return after(u[1:], symbol)
        d, total = len(nexts[u]), sum(nexts[u].values())
        return (nexts[u][symbol] + d * after(u[1:], symbol)) / (total + d)

    assert abs(sum(after(b" alph", s) for s in range(256)) - 1) < 1e-9 and abs(sum(after(b"zzz a", s) for s in range(256)) - 1) < 1e-9
    return after


def brute_counts(text):
    text = text or ""
    w = words(text)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    inside = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, docs, empty):
    more = spark.createDataFrame([(1000 + i, " ".join(f"w{j}{'#' if i % 2 else ''}" for j in range(i, i + 40))) for i in range(300)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").union(more)
    labels = spark.createDataFrame([(1000 + i, 1 - i % 2) for i in range(300)] + [(None, 1), (1000, None)], "doc_id bigint, quality int")
    judged, rules = quality.judge(both, labels)
    want = sorted((str(d), *brute_counts(t)) for d, t in data(both))
    got = judged.collect()
    assert sorted((str(r.doc_id), *[r[c] for c in quality.COUNTS[:5]]) for r in got) == want
    assert rules and all(r.kept == (r.doc_id % 2 == 0) for r in got if (r.doc_id or 0) >= 1000)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs, labels)[0].where("kept").count()
    odd = docs.withColumns({"a.b": chat.F.lit(1), "n_words": chat.F.lit(2), "quality": chat.F.lit(3)})
    again = quality.keep(odd, labels)
    assert again.columns == odd.columns and again.count() == kept.count() and all(r["n_words"] == 2 and r["a.b"] == 1 for r in again.collect())
    many = spark.createDataFrame([(1000, " ".join(f"w{j}" for j in range(30 + i))) for i in range(400)], "doc_id bigint, text string")
    assert len(quality.fit(both.union(many), labels, max_train=50)) <= 12
    assert quality.keep(empty, labels).count() == 0
    assert quality.judge(docs, labels.limit(0))[1] == []


def test_grow_tries_all_cuts():
    n = 6000
    x = {f: np.zeros(n) for f in quality.FEATURES} | {"digit_share": np.arange(n) / n}
    bad = np.arange(n) >= n - 9
    assert quality.grow(x, bad).tests == (("digit_share", ">=", ((n - 10) / n + (n - 9) / n) / 2),)


def test_mixing(docs, empty):
    got = mixing.mix(docs, share=1.0)
    assert set(docs.columns) <= set(got.columns) and got.count() == docs.count()
    half = mixing.mix(docs, share=0.5).collect()
    assert 0 < len(half) < docs.count() and all(0 < r.probability <= 1 for r in half)
    assert sorted(map(str, half)) == sorted(map(str, mixing.mix(docs, share=0.5).collect()))
    assert mixing.mix(empty).count() == 0


def cells_of(spark, size):
    return spark.createDataFrame([(*k, n) for k, n in size.items()], "source string, lang string, topic string, tokens bigint")


def test_raking_meets_marginals(spark):
    rng = random.Random(2)
    size = {(s, la, t): rng.randint(1, 90) for s in "abc" for la in "xy" for t in "pq"}
    rows = mixing.fit(cells_of(spark, size), 0.6, 0.5)[0].collect()
    for axis in mixing.AXES:
        own = defaultdict(float)
        natural = defaultdict(float)
        for r in rows:
            own[r[axis]] += r.weight
            natural[r[axis]] += size[r.source, r.lang, r.topic]
        norm = sum(v**0.5 for v in natural.values())
        assert all(abs(own[k] - natural[k] ** 0.5 / norm) < 1e-3 for k in own)
    assert abs(sum(r.p * size[r.source, r.lang, r.topic] for r in rows) - 0.6 * sum(size.values())) < 1e-6 * sum(size.values())


def filled(natural, goal, budget):
    """min(natural, c * goal) per value, for the c by which they sum to the budget: by bisection."""
    low, high = 0.0, 1e12
    for _ in range(300):
        c = (low + high) / 2
        low, high = (low, c) if sum(min(v, c * goal[k]) for k, v in natural.items()) > budget else (c, high)
    return {k: min(v, c * goal[k]) for k, v in natural.items()}


def brute_fit(size, share, goals):
    """Bounded raking, each step by bisection: for each axis value the factor by which min(1, ...) meets its reachable tokens."""
    natural = [defaultdict(float) for _ in range(3)]
    for k, n in size.items():
        for axis in range(3):
            natural[axis][k[axis]] += n
    reach = [filled(natural[a], goals(a, natural[a]), share * sum(size.values())) for a in range(3)]
    ratio = dict.fromkeys(size, 1.0)
    for step in range(600):
        axis = step % 3
        for v, want in reach[axis].items():
            own = {k: n for k, n in size.items() if k[axis] == v}
            low, high = 0.0, 1e6
            for _ in range(60):
                c = (low + high) / 2
                low, high = (low, c) if sum(n * min(1, c * ratio[k]) for k, n in own.items()) > want else (c, high)
            if want > sum(own.values()) - 1e-6:
                c = max(1.0, 1 / min(ratio[k] for k in own))
            for k in own:
                ratio[k] *= c
    return {k: min(1.0, r) for k, r in ratio.items()}, natural, reach


@pytest.mark.parametrize("targets", [None, {"lang": {"x": 0.3}, "topic": {"p": 0.5, "q": 0.25, "r": 0.25}}])
def test_sampled_tokens_meet_reachable_marginals(spark, targets):
    """The marginals of probability times tokens, not of weights before clipping; a target beyond its tokens is all of them."""
    rng = random.Random(6)
    size = {(s, la, t): rng.randint(1, 90) * (40 if t == "p" else 1) for s in "abc" for la in "xy" for t in "pqr"}
    share, total = 0.6, sum(size.values())

    def goals(axis, natural):
        given = (targets or {}).get(mixing.AXES[axis])
        if not given:
            return {k: v**0.7 for k, v in natural.items()}
        others = sum(v for k, v in natural.items() if k not in given)
        return {k: given[k] if k in given else (1 - sum(given.values())) * v / others for k, v in natural.items()}

    fitted, report = mixing.fit(cells_of(spark, size), share, 0.7, targets=targets)
    p = {(r.source, r.lang, r.topic): r.p for r in fitted.collect()}
    want, natural, reach = brute_fit(size, share, goals)
    assert len(p) == len(size) and all(0 < v <= 1 for v in p.values())
    assert all(abs(p[k] - want[k]) < 0.002 for k in size)
    told, full = {(r.axis, r.value): r for r in report.collect()}, 0
    for axis, name in enumerate(mixing.AXES):
        norm = sum(goals(axis, natural[axis]).values())
        for k, v in natural[axis].items():
            own = sum(n * p[c] for c, n in size.items() if c[axis] == k)
            full += reach[axis][k] > v - 1e-6
            r = told[name, k]
            assert abs(own - reach[axis][k]) < 0.002 * total and r.natural == v
            assert abs(r.goal - goals(axis, natural[axis])[k] / norm) < 1e-9
            assert abs(r.reachable - reach[axis][k] / (share * total)) < 1e-6 and abs(r.expected - own / (share * total)) < 1e-9
    assert full


def test_mixing_of_odd_columns_and_given_tokens(spark, docs, empty):
    odd = docs.withColumns({"p": chat.F.lit(1), "tokens": chat.F.lit(2), "__tokens": chat.F.lit(3), "a.b": chat.F.lit(4), "topic": chat.F.lit("mine"), "id": chat.F.lit(5)})
    got = mixing.mix(odd, share=1.0, tokens=chat.F.length("text"))
    assert got.columns == [*(c for c in odd.columns if c != "topic"), *mixing.ADDED]
    rows = got.collect()
    assert len(rows) == docs.count() and all((r.p, r["tokens"], r["__tokens"], r["a.b"], r.id) == (1, 2, 3, 4, 5) for r in rows)
    assert all(r.n_tokens == max(1, len(r.text or "")) and r.probability == 1 for r in rows)
    for bad in ({"colour": {}}, {"lang": {"en": 0.7, "de": 0.7}}):
        with pytest.raises(ValueError):
            mixing.mix(docs, targets=bad)


def test_sample_is_the_hash_below_the_probability(docs):
    """Each id by itself: the first 52 bits of md5 of seed and id, against the probability that is reported."""
    whole = {(r.doc_id, r.text): r for r in mixing.mix(docs, share=0.5).collect()}
    cells = mixing.fit(mixing._cells(mixing._marked(docs, None, None)), 0.5)[0].collect()
    p = {(r.source, r.lang, r.topic): r.p for r in cells}
    for r in mixing.mix(docs, share=1.0).collect():
        unit = int(hashlib.md5(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert ((r.doc_id, r.text) in whole) == (unit < p[r.source or "unknown", r.lang or "unknown", r.topic])


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    near = base[:40].repeat(3, axis=0) + rng.standard_normal((120, 64)) * 0.17
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate([*base, *near, base[0], base[0]])]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 64), (n + 3, [float("nan")] + [1.0] * 63), (n + 4, [1.0] * 8), (n + 5, [2.0] * 8), (n + 6, [None] * 64)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    for most in (2000, 16):
        got = {r.vec_id: r for r in lattice.dedup(df, most_rows=most).collect()}
        x = np.array([v for _, v in rows[:n]])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        close = x @ x.T >= 0.95
        found = sum(got[i].n_links for i in range(n))
        assert close.sum() - n >= found >= 0.95 * (close.sum() - n)
        assert all(got[i].n_links == 0 and got[i].kept for i in (n, n + 1, n + 2, n + 3, n + 6)) and got[n + 5].component_id == n + 4
        assert got[n - 1].component_id == 0
        up = list(range(n))
        find = lambda i: i if up[i] == i else find(up[i])
        for i, j in np.argwhere(close).tolist():
            up[max(find(i), find(j))] = min(find(i), find(j))
        if found == close.sum() - n:
            assert all((got[i].n_links, got[i].component_id, got[i].kept) == (close[i].sum() - 1, find(i), find(i) == i) for i in range(n))
        else:
            assert all(got[i].n_links <= close[i].sum() - 1 and find(got[i].component_id) == find(i) for i in range(n))
    more = df.withColumnRenamed("vec_id", "id").selectExpr("case when id = 1 then null else id end as vec_id", "embedding", "1 as fp", "2 as raw", "3 as `a.b`")
    odd = lattice.dedup(more).collect()
    assert len(odd) == len(rows) and sum(r.vec_id is None for r in odd) == 1
    assert lattice.dedup(df.limit(0)).count() == 0


def test_scaled_vectors(spark):
    """Copies by powers of two are one class; values that floats can't hold stay doubles."""
    v = [0.1, -0.7, 3.0, 1e-30]
    rows = [(0, v), (1, [x * 4 for x in v]), (2, [x * 1.0000001 for x in v]), (3, [-x for x in v]), (4, [0.1, -0.7, 3.0, -0.0]), (5, [0.1, -0.7, 3.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (0, 3), 4: (4, 0), 5: (4, 0)}


def test_privacy(docs, empty, spark):
    assert privacy.base_spans("a@b.c@d.e 1.2.3.4.5.6.7.8 300.1.1.1 +1 (663) 555-6869. x") == [(0, 5, "email"), (10, 17, "ip"), (18, 25, "ip"), (36, 53, "phone")]
    assert privacy.base_spans("4465 7583-8288 9437") == [(0, 19, "card")] and privacy.base_spans("4465758382889438") == []
    secret = [(500 + i, f"{WORDS[i]} {WORDS[i + 1]} zorblax wrote from jo@secret.example.org about {WORDS[i + 2]}") for i in range(6)] + [(600, "nobody but Zorblax, knows")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(secret, "doc_id bigint, text string"))
    for few in (100, 0):
        got = {r.doc_id: r for r in privacy.digest(privacy.spans(df, few=few)).where("doc_id >= 500").collect()}
        assert got[600].spans == "term:11:18" and got[600].n_email == 0 and got[600].base_sha256 == hashlib.sha256(b"").hexdigest()
        assert got[500].n_email == 1 and "term:11:18" in got[500].spans
    clean = privacy.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where("text like '%[EMAIL]%[PHONE]%[IP]%[CARD]%'").count() == 1 and clean.where("text is null").count() == 1
    odd = docs.withColumns({"a.b": chat.F.lit(1), "spans": chat.F.lit(2), "doc": chat.F.lit(3)})
    again = privacy.sanitise(odd)
    assert again.columns == odd.columns and {(r["a.b"], r["spans"]) for r in again.collect()} == {(1, 2)}
    assert sorted(str(r.text) for r in again.collect()) == sorted(str(r.text) for r in clean.collect())
    assert privacy.sanitise(empty).count() == 0


def test_privacy_of_repeated_lines(spark):
    """A contact line that is the same everywhere reveals its name and user name, near or far; words that are common don't."""
    line = "{} alpha beta gamma delta epsilon zeta eta ask Quibbly alias quib_77"
    spelt = ("Jo@Secret.example.org", "jo@secret.example.org", "JO@secret.example.org", "jo@secret.EXAMPLE.org")
    rows = [(i, "alpha beta gamma\n" + line.format(m)) for i, m in enumerate(spelt)]
    rows += [(10 + i, "alpha beta gamma delta epsilon zeta eta ask alias") for i in range(60)] + [(90, "later quibbly met quib_77 10.0.0.1 x"), (91, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.term for r in privacy.revealing(df).collect()} == {"quibbly", "quib_77"}
    for few in (100, 0):
        got = {r.doc_id: r.spans for r in privacy.digest(privacy.spans(df, few=few)).collect()}
        assert got[90] == "term:6:13,term:18:25,ip:26:34" and got[91] == "" and got[10] == ""
    assert privacy.sanitise(df).where("doc_id = 0").first().text == "alpha beta gamma\n[EMAIL] alpha beta gamma delta epsilon zeta eta ask [TERM] alias [TERM]"


@pytest.mark.parametrize("few", [privacy.FEW_TERMS, -1])
def test_sanitise_passes_texts_to_one_worker(docs, few):
    clean = privacy.sanitise(docs, few=few)
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    want = [(d, None if t is None else privacy.generalised(t, plain_spans(t))) for d, t in data(docs)]
    assert sorted(data(clean), key=repr) == sorted(want, key=repr)


def test_stages_bound_batches_to_workers(spark):
    import pyarrow as pa

    import corpus_pipeline

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    wide = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('alpha beta ', 400) AS text")
    stage = corpus_pipeline.bounded(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n bigint, size bigint"))
    try:
        got = stage(spark, wide, "").collect()
        assert sum(r.n for r in got) == 4000 and max(r["size"] for r in got) < 2 * corpus_pipeline.BATCH_BYTES
        spark.conf.set(corpus_pipeline.BATCH_CONF, str(1 << 30))
        assert len(stage(spark, wide, "").collect()) == 1  # the session's own bound holds
    finally:
        spark.conf.unset(corpus_pipeline.BATCH_CONF)


def test_sharding(docs, empty):
    got = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in data(docs))
    total, top = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in {r.shard for r in got}:
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own))) and 0 <= s < 24
        assert sum(r["size"] for r in own) <= total / 24 + top
    at, rank = 0, Counter()
    want = []
    for d, crc, size in sorted((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r["size"]) for r in got):
        number = (2 * at + size) * 24 // (2 * total)
        want.append((d, crc, size, number, rank[number]))
        rank[number] += 1
        at += size
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r["size"], r.shard, r.slot) for r in got) == want
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [-1 if r.doc_id is None else r.doc_id for r in order] == sorted(-1 if r.doc_id is None else r.doc_id for r in order)
    assert sharding.shard(empty).count() == 0


def row_components(rows, n, tenths):
    """(id, set size, component) of each row, by all pairs."""
    sets = []
    for _, t in rows:
        w = words((t or "").encode().translate(LOWER).decode())
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= tenths * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def brute_components(rows, n, tenths):
    return Counter((str(d), size, str(c)) for d, size, c in row_components(rows, n, tenths))


@pytest.mark.parametrize(("n", "tenths", "most"), [(3, 90, 1500), (5, 80, 1500), (3, 90, 4)])
def test_jaccard(spark, docs, empty, n, tenths, most):
    rng = random.Random(9)
    long = [rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(400)]
    family = []
    for i in range(30):
        w = list(long)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 5)}"
        family.append((2000 + i, " ".join(w[: rng.randint(340, 400)])))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(family, "doc_id bigint, text string"))
    got = Counter((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join(df, n, tenths, most_docs=most).collect())
    assert got == brute_components(data(df), n, tenths)
    if most == 4:
        assert jaccard.join(empty).count() == 0 and jaccard.representatives(empty).count() == 0
        joined = Counter((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join(df, n, tenths, most_docs=most, few=0).collect())
        assert joined == got
    if tenths == 80:
        least = {(d, c) for d, _, c in brute_components(data(docs), 5, 80)}
        want = {d for d, c in least if d == c}
        odd = docs.withColumns({"a.b": chat.F.lit(1), "hash": chat.F.lit(2), "id": chat.F.lit(3), "n": chat.F.lit(4), "gone_id": chat.F.lit(5)})
        for few in (10**6, 0):
            kept = jaccard.representatives(odd, few=few)
            assert kept.columns == odd.columns and kept.where("doc_id = 7").count() == 1
            assert {str(r.doc_id) for r in kept.collect()} == want | {"None"}
            assert Counter(tuple(r) for r in kept.collect()) <= Counter(tuple(r) for r in odd.collect())


def test_signatures_are_combined_before_they_travel(spark, monkeypatch):
    """Copies of a passage in very many texts: rows of a signature per task and bound, not per text; nothing is lost."""
    monkeypatch.setattr(jaccard, "MOST_SIGS", 500)
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(40)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(300)] + [(1000 + i, " ".join(f"x{rng.randint(0, 10**6)}" for _ in range(30))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.join(df).collect()}
    assert {got[i] for i in range(300)} == {0} and all(got[1000 + i] == 1000 + i for i in range(50))


def test_chat(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 1, "cy", None), (1, 1, "bob", "yo"), (2, None, None, "x"), (None, 0, "ann", "lost")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", chat.F.lit(1)).repartition(3)
    for most in (10_000, 2):
        got = chat.rotate(df, most).collect()
        assert len(got) == 4 * 3 + 1 + 1
        bob = sorted((r for r in got if r.conv_id == 1 and r.perspective == "bob"), key=lambda r: r.position)
        assert "".join(r.segment for r in bob) == "<|user:ann|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|assistant|>\nyo<|end|>\n<|user:cy|>\n<|end|>\n"
        assert [r.segment[r.loss_start : r.loss_end] for r in bob] == ["", "yo<|end|>\n", "yo<|end|>\n", ""]
        whole = {(r.conv_id, r.perspective): r for r in chat.dialogues(chat.rotate(df, most)).collect()}
        assert len(whole) == 3 + 1 + 1 and whole[1, "bob"].text == "".join(r.segment for r in bob)
        assert [whole[1, "bob"].text[m.start : m.end] for m in whole[1, "bob"]["mask"]] == ["yo<|end|>\n", "yo<|end|>\n"]
        assert whole[None, "ann"].text == "<|assistant|>\nlost<|end|>\n" and whole[2, "unknown"].text == "<|assistant|>\nx<|end|>\n"
    huge = {(r.conv_id, r.perspective): r.text for r in chat.dialogues(chat.rotate(df), most_chars=40).collect()}
    assert huge[1, "bob"] is None and huge[None, "ann"]
    assert chat.rotate(df.limit(0)).count() == 0 and chat.dialogues(chat.rotate(df.limit(0))).count() == 0


def test_one_huge_conversation(spark):
    rng = random.Random(8)
    rows = [(5, i // 2, rng.choice("ab"), "long " * 3000 if i == 7 else f"t{rng.randint(0, 3)}") for i in range(400)] + [(i, 0, "a", "x") for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, chat.rotate(df, 100).collect())) == sorted(map(key, chat.rotate(df).collect()))


def test_components(spark, monkeypatch):
    from quillon.llm import common

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 200) if i % 50] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(500, i) for i in range(501, 600)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    few = {r.id: r.root for r in components(df).collect()}
    monkeypatch.setattr(common, "FEW_EDGES", 0)
    many = {r.id: r.root for r in components(df).collect()}
    group = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert group(few) == group(many) and len({many[i] for i in range(501, 600)}) == 1


def test_bloom(spark):
    for n in (0, 1000, 300_000):
        bits = Bloom.build(spark.range(n), "id")
        keys, others = np.arange(n).astype(np.uint64), np.arange(10**6, 10**6 + 10000).astype(np.uint64)
        assert Bloom.has(bits, keys).all() and all(Bloom.maybe(bits.tobytes(), k) for k in range(min(n, 1000)))
        assert Bloom.has(bits, others).mean() < 0.01
        assert [Bloom.maybe(bits.tobytes(), int(k)) for k in others[:200]] == Bloom.has(bits, others[:200]).tolist()
    assert len(bits) * 8 >= 12 * 300_000


def test_shared_folder_of_a_cluster_must_be_set():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: None), "setCheckpointDir": staticmethod(lambda _: None), "master": "spark://head:7077"})

    for master in ("spark://head:7077", "local-cluster[3,2,1000]", "yarn"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(Session)
    Session.sparkContext.master = "local[4]"
    assert shared_folder(Session)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 50 and {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "pii", "mixing", "best_fit_packing"]


def plain_spans(text):
    """Base spans by the stated patterns as they stand."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) in range(0, 1000, 10):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(s, e, privacy.KINDS[k]) for s, k, e in sorted(found)]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(12)
    parts = ["a", "b.c", "@", ".", "-", "+1", " ", "(", ")", "10", "255", "256", "4465758382889437", "4465 7583-8288 9437", "x@y.z", "1.2.3.4", "\n", "é", "%", "_"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert privacy.base_spans(text) == plain_spans(text), text


def test_pipeline_equals_plain_python(spark, docs, tmp_path):
    """Every stage's decisions, from documents to pieces, by plain Python on a small fixture without labels."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(21)
    more = []
    for i in range(120):
        text = " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(rng.randint(15, 400)))
        text = text.replace(" ", "\n", rng.choice([0, 0, 30])).replace(" ", " | ", rng.choice([0, 0, 0, 6]))
        more.append((3000 + i, text + (f" write to p{i}@mail.example.org" if i % 7 == 0 else ""), rng.choice(["en", "en", "de", "fr"]), rng.choice("pqr"), 1, "r", "t", 5))
    more += [(4000 + i, more[i][1] + " and more", "de", "q", 1, "r", "t", 5) for i in range(20)]
    rows = docs.union(spark.createDataFrame(more, SCHEMA)).select("doc_id", "text", "lang", "source").withColumn("n_chars", chat.F.length("text").cast("bigint"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = [(r.doc_id, r.text, r.lang or "unknown", r.source or "unknown") for r in rows.collect()]
    counts = [brute_counts(t) for _, t, _, _ in left]
    left = [x for x, c in zip(left, counts, strict=True) if c[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    placed = row_components([x[:2] for x in left], 5, 80)
    left = list({(x[0], x[1]): x for x, (d, _, c) in zip(left, placed, strict=True) if d is None or c == d}.values())
    left = [(d, privacy.generalised(t, plain_spans(t)), la, so) for d, t, la, so in left]
    assert any("[EMAIL]" in t for _, t, _, _ in left)

    def cell(text, lang, source):
        size = len(text.encode())
        topic = "table" if text.count("|") >= 5 else "list" if text.count("\n") >= 20 else "short" if size < 600 else "long" if size > 6000 else "prose"
        return source, lang, topic

    size = Counter()
    for _, t, la, so in left:
        size[cell(t, la, so)] += t.count(" ") + t.count("\n") + 1
    p = brute_fit(size, 0.8, lambda _, natural: {k: v**0.7 for k, v in natural.items()})[0]
    unit = lambda d: int(hashlib.md5(f"1:{'' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
    kept = [(d, t) for d, t, la, so in left if unit(d) < p[cell(t, la, so)]]
    assert 0 < len(kept) < len(left)
    whole, want = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json"), Counter()
    for d, t in kept:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[d, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


@pytest.mark.parametrize("name", ["op6_e8_near_dedup", "op9_ngram_jaccard_join", "op10_chat_rotation"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from quillon.llm import entry

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df, want = entry.queries()[name](spark, data), con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(tuple(r[c] for c in want.columns) for r in df.collect()) == Counter(want.fetchall())
