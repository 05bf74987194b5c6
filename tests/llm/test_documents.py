"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from namewright.llm import compression_language, encoding, grace_dedup, mixture, packing, partenum, token_counts, token_files
from namewright.llm.components import components

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def rng_docs(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    out = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 120)))
        if out and i % 3 == 0:
            words = rng.choice(out)[1].split(" ")
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        out.append((i, text, "en", rng.choice(["a", "b", None])))
    return out


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_ids_of_whole_texts(path, odd_rows):
    import pyarrow as pa

    texts = [r[1] for r in odd_rows] + [" lead", "trail ", "two  spaces", "l'été d'1 fois 12's", "x\n\ny \n z", "İ ΑΣ ς", "a\u0301b", "x İ... y", "İ,", "aİ.", "\u212a. ﬁ,"]
    rng, signs = random.Random(5), [*"abZ09.,;'-!éßİıſ\u212a", "İ.", " ", " ", " ", "\n", "\u0301", "ﬁ", " the"]
    texts += ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(3000)]
    enc, tok = encoding.PieceEncoder(path, cache=3000), Tokenizer.from_file(path)
    got = [ids[a:b].tolist() for _, ids, bounds in enc.slices(pa.array(texts)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got == want
    assert enc.counts(pa.array(texts)).tolist() == [len(w) for w in want]


def test_token_counts(odd, odd_rows, make_docs):
    histogram = token_counts.length_histogram(odd, BYTES)
    lengths = np.array([len(ids_of(BYTES, r[1])) for r in odd_rows])
    assert {r.n_tokens: r.n_docs for r in histogram.collect()} == dict(Counter(lengths.tolist()))
    sums = token_counts.suffix_sums(histogram).collect()
    for r in sums:
        assert r.docs_at_least == (lengths >= r.n_tokens).sum()
        assert r.tokens_at_least == lengths[lengths >= r.n_tokens].sum()
        assert r.tokens_at_limit == np.minimum(lengths, r.n_tokens).sum()
        assert r.share_within == pytest.approx((lengths <= r.n_tokens).mean())
    kept = token_counts.at_limit(token_counts.suffix_sums(histogram), 100).first()
    assert (kept.docs_cut, kept.tokens_kept) == ((lengths > 100).sum(), np.minimum(lengths, 100).sum())
    assert token_counts.quantile(token_counts.suffix_sums(histogram), 0.5).first()[0] == np.sort(lengths)[int(np.ceil(0.5 * len(lengths))) - 1]
    assert token_counts.suffix_sums(token_counts.length_histogram(make_docs([]), BYTES)).count() == 0


def brute_groups(rows):
    by = defaultdict(list)
    for r in rows:
        by[SPACE.sub(" ", r[1] or "")].append(r[0])
    return by


def test_exact_dedup(odd, odd_rows, make_docs):
    got = grace_dedup.exact_dedup(odd).collect()
    assert len(got) == len(odd_rows)
    for text, ids in brute_groups(odd_rows).items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == digest]
        known = [i for i in ids if i is not None]
        assert len(mine) == len(ids) and all(r.group_size == len(ids) for r in mine)
        assert {r.keep_id for r in mine} == {min(known) if known else None}
        assert sum(r.kept for r in mine) == 1
    kept = grace_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len(brute_groups(odd_rows))
    assert grace_dedup.exact_dedup(make_docs([])).count() == 0


def test_grace_spills_and_recurses():
    rng = random.Random(1)
    contents = [f"{rng.randrange(400)}-" + "x" * rng.randrange(300) for _ in range(5000)]
    records = [(zlib.crc32(c.encode()) * 0x9E3779B97F4A7C15 & (1 << 63) - 1, c, [1]) for c in contents]

    def add(into, state):
        into[0] += state[0]

    got = {c: s[0] for _, c, s in grace_dedup.grace(records, add, budget=4000)}
    assert got == Counter(contents)
    same_hash = [(7, c, [1]) for c in contents[:200]]
    assert {c: s[0] for _, c, s in grace_dedup.grace(same_hash, add, budget=500)} == Counter(contents[:200])


def test_grace_holds_no_copies():
    """Copies leave as they come, those of spilled texts too; each names the first record with its text."""
    texts = [f"text {i % 300} " * 3 for i in range(6000)]
    records = [(zlib.crc32(t.encode()) << 28, t, [i, 1]) for i, t in enumerate(texts)]

    def add(into, state):
        into[1] += state[1]
        return state[0], into[0]

    left, ends = {}, {}
    for h, content, state in grace_dedup.grace(records, add, budget=3000):
        if h is None:
            left[state[0]] = state[1]
        else:
            ends[content] = state
    assert left == {i: i % 300 for i in range(300, 6000)}
    assert ends == {texts[i]: [i, 20] for i in range(300)}


def test_exact_dedup_of_many_copies(make_docs):
    rng = random.Random(4)
    rows = [(i, rng.choice(["", "same  text", "x " * 400, f"own {i % 700}"])) for i in rng.sample(range(3000), 3000)]
    got = grace_dedup.exact_dedup(make_docs(rows)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(d, min(g), len(g)) for g in brute_groups(rows).values() for d in g}
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_mixture(make_docs):
    rows = rng_docs(400)
    got = mixture.mix(make_docs(rows)).collect()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    total, sizes = sum(size.values()), Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(total)
    while True:  # water-filling, a round at a time
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    taken = Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[source[r.doc_id]] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size.values()) / 2 + 1
    again = mixture.mix(make_docs(rows[::-1])).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def test_repeated_rows_keep_columns_of_any_name(make_docs):
    docs = make_docs([(i, "w " * (i % 9), "en", f"s{i % 3}") for i in range(60)])
    taken = {r.doc_id: r.taken for r in mixture.mix(docs).collect()}
    got = mixture.repeat_rows(docs)
    assert got.columns == docs.columns
    times = Counter(r.doc_id for r in got.collect())
    assert all(times[i] * (i % 9) == taken[i] for i in range(60) if i % 9) and all(times[i] == 1 for i in range(0, 60, 9))
    assert {(r.target, r.whole, r.upto, r.source_size, r.plan_source) for r in got.collect()} == {(1.5, 1, 2, 3, "p")}


def test_mixture_caps_a_small_source(make_docs):
    rows = [(i, "a b c d", "en", "a") for i in range(100)] + [(1000, "x y", "en", "b")]
    got = mixture.mix(make_docs(rows)).collect()
    assert {r.target for r in got if r.doc_id == 1000} == {6.0} and {r.taken for r in got if r.doc_id == 1000} == {6}
    assert {r.target for r in got if r.doc_id < 1000} == {396.0}


def test_mixture_odd(odd, make_docs):
    assert mixture.mix(odd).count() == 12
    assert mixture.mix(make_docs([])).count() == 0
    assert mixture.mix(make_docs([(1, None), (2, "")])).filter("target = 0 and taken = 0").count() == 2
    assert mixture.repeat_rows(odd).columns == odd.columns


def test_token_files(odd, odd_rows, make_docs):
    got = token_files.token_files(odd, WORDS, 1).collect()
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for d, t, *_ in rows:
        ids = [*ids_of(WORDS, t), 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_files(make_docs([]), WORDS, 1).count() == 0


def unpacked(rows, docs, limit):
    by, places = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= limit
    return by, len(places)


def test_packing(make_docs):
    rows = rng_docs(300) + [(1000, "word " * 5000)]
    got = packing.pack(make_docs(rows), BYTES, 2, 128).collect()
    by, n = unpacked(got, rows, 128)
    total = 0
    for d, t, *_ in rows:
        ids = [*ids_of(BYTES, t), 2]
        total += len(ids)
        pieces = sorted(by[d], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // 128)))
        assert all(p.length == 128 for p in pieces[1:]) and sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert n <= 1.03 * -(-total // 128) + 1
    assert packing.pack(make_docs([]), BYTES).count() == 0


def test_packing_odd(odd):
    got = packing.pack(odd, BYTES).collect()
    unpacked(got, None, 1024)
    assert sum(r.piece == 0 for r in got) == 12


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_rank(seed):
    rng = random.Random(seed)
    hist = Counter(min(1023, max(1, int(rng.choice([rng.uniform(1, 1023), rng.lognormvariate(4, 1)])))) for _ in range(rng.choice([1, 20, 3000])))
    for groups in (4, packing.GROUPS):
        n, runs = packing.make_plan(dict(hist), 1024, groups)
        used, seen = defaultdict(list), Counter()
        for size, a, b, seq, per, at in runs:
            seen[size] += b - a
            for r in range(b - a):
                used[seq + r // per].append((at + r % per * size, size))
        assert seen == hist and set(used) == set(range(n))
        for p in used.values():
            end = 0
            for at, size in sorted(p):
                assert at == end
                end += size
            assert end <= 1024


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_jaccard_join(make_docs, odd, odd_rows):
    rows = rng_docs(150) + [(500 + i, "same words again and again in this text " * 2 + str(i)) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_components(make_docs(rows)).collect()}
    assert got == brute_components(rows)
    got = partenum.jaccard_components(odd).collect()
    assert len(got) == 12 and {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(odd_rows)
    assert partenum.jaccard_components(make_docs([])).count() == 0
    kept = partenum.keep_one(make_docs(rows))
    assert kept.columns == odd.columns and kept.count() == len({c for _, c in brute_components(rows).values()})


def test_jaccard_join_of_repeated_ids(make_docs):
    a, b, c = "a b c d e f g", "h i j k l m n o", "p q r s t u v"
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, ""), (5, c), (6, None)]
    want = {(1, 3, 1), (1, 4, 1), (2, 3, 1), (3, 4, 1), (4, 3, 4), (4, 0, 4), (5, 3, 4), (6, 0, 6)}
    for order in (rows, rows[::-1]):
        got = partenum.jaccard_components(make_docs(order)).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)


def test_equal_sets_send_signatures_once(make_docs, spark):
    rows = [(3, "a b c d e f"), (1, "A b  c d e f"), (1, "x y z"), (2, "x y z"), (2, "p q r s t u"), (5, "a b c d e f"), (5, "x y z"), (4, None), (None, "a b c d e f")]
    want = [1, 1, 2, 2, 4]
    for threshold in ("10MB", "-1"):  # broadcast, and beyond its bound
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = partenum._Join(make_docs(rows)).first_of_equals()
            assert sorted(r["doc_id"] for r in got.collect()) == want
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (threshold == "10MB")
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_jaccard_join_of_large_groups(make_docs, monkeypatch):
    monkeypatch.setattr(partenum, "SMALL", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_components(make_docs(rows)).collect()}
    assert got == brute_components(rows)


def test_signatures_are_shared_by_similar_sets():
    rng = np.random.default_rng(2)
    for n in [1, 2, 3, 5, 7, 8, 15, 16, 40, 63, 64, 200, 900]:
        for _ in range(20):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            out = int(rng.integers(0, n // 7 + 1))
            b = np.concatenate((a[out:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 7 + 1)), dtype=np.uint64)))
            common = len(np.intersect1d(a, b))
            if 4 * common < 3 * (len(a) + len(b) - common):
                continue
            a, b = np.sort(a), np.sort(b)
            sig, row = partenum.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())
            for often in (a[::2], np.concatenate((a, b))):
                sig, row = partenum.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), np.unique(often))
                assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())
            x, y = partenum.sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            assert partenum._close(len(a), int.from_bytes(x, "little"), 8 * len(x), len(b), int.from_bytes(y, "little"), 8 * len(y))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 101), (205, 200), (203, 205)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200, 203: 200, 205: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def language_docs(n):
    rng = random.Random(4)
    words = {"aa": ["the", "thing", "other", "with", "that", "which"], "bb": ["der", "und", "nicht", "eine", "schon", "auch"], "cc": ["les", "que", "pour", "dans", "avec", "est"]}
    return [(i, " ".join(rng.choice(w) + rng.choice("aeiou") for _ in range(60)), lang) for i in range(n) for lang, w in [rng.choice(list(words.items()))]]


def test_language_id(make_docs, odd):
    rows = language_docs(300) + [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "", None), (None, "the thing other", "aa")]
    got = {r.doc_id: r for r in compression_language.identify(make_docs(rows)).collect()}
    held = [r for r in rows[:300] if got[r[0]].held_out]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows[:300])
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held) and len(held) > 40
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert compression_language.identify(odd).count() == 12
    assert compression_language.identify(make_docs([])).count() == 0
    kept = compression_language.keep_identified(make_docs(rows))
    assert kept.columns == odd.columns and kept.count() >= 0.97 * 300


def test_language_samples_are_cleaned_beside_a_rare_language():
    import random

    from namewright.llm import compression_language

    rng = random.Random(5)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(60)] for lang, letters in (("aa", "abcdefgh"), ("bb", "opqrstuv"))}
    text = lambda lang: " ".join(rng.choices(words[lang], k=80))
    parts = {lang: [text(lang) for _ in range(40)] for lang in words}
    foreign = text("bb")
    parts["aa"][7] = foreign
    assert foreign not in compression_language.cleaned(parts)["aa"]
    got = compression_language.cleaned({**parts, "a": parts["aa"][:3]})
    assert {k: got[k] for k in parts} == compression_language.cleaned(parts) and got["a"] == parts["aa"][:3]
