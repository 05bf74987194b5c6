"""Search, URL filters, secret scans and the pipeline against brute force."""

import math
import random
import re

import numpy as np

from namewright.llm import ball_tree, secret_forest, url_templates


def brute_top(rows, k=5):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * float(np.float32(x))) for x in v]
        vectors[i] = min(vectors.get(i, w), w)
    out = set()
    for q in vectors:
        if q % 50:
            continue
        best = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_ball_tree_search(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]
    rows += [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, [0.0] * 8), (50, rows[50][1]), (3000, [1.0, 2.0]), (3001, [1.0, -2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, shard int").repartition(3)
    for size in (60, 50_000):
        got = ball_tree.top_k(df, df.vec_id % 50 == 0, shard_size=size).collect()
        assert {tuple(r) for r in got} == brute_top(rows)
    assert ball_tree.top_k(df.limit(0), df.vec_id % 50 == 0).count() == 0


def test_ball_tree_prunes():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 6)) * 1000
    v = np.floor(centers[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 6)))
    tree = ball_tree.BallTree(np.arange(4000), v, leaf=64)
    seen = []
    scan = tree._scan
    tree._scan = lambda leaf, rows: (seen.append(len(leaf) * len(rows)), scan(leaf, rows))
    row, ids, score = tree.search(np.full(10, -1), v[:10], 5, np.full(10, -np.inf))
    assert sum(seen) < 0.5 * 4000 * 10
    for q in range(10):
        s = v @ v[q]
        want = sorted(zip(-s, range(4000), strict=True))[:5]
        assert sorted(zip(-score[row == q], ids[row == q], strict=True)) == want


def test_queries_visit_few_shards_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 8)) * 5
    rows = [(i, (centers[i % 30] + rng.normal(size=8) / 20).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    visits, routes = [], ball_tree._routes

    def counted(*args):
        out = routes(*args)
        visits.append(out.count())
        return out

    ball_tree._routes = counted
    try:
        got = ball_tree.top_k(df, df.vec_id % 50 == 0, shard_size=60).collect()
    finally:
        ball_tree._routes = routes
    assert {tuple(r) for r in got} == brute_top(rows)
    assert len(visits) == 2 and sum(visits) < 0.5 * 60 * 49  # 60 queries, 50 shards or more


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_url_rules_and_parts(spark):
    urls = {
        "https://WWW.Example.com/en/1?x#y": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://example.com?q=/en/": ("example.com", "", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://n.net/es/a://b": ("n.net", "/es/a://b", "net/es/", "block"),
        "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://ÀB.org/Ä": ("Àb.org", "/Ä", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "t", "b") for i, u in enumerate(urls)], "page_id long, url string, template string, branch string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(pages, none, RULES).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_templates.judge(pages.limit(0), none, RULES).count() == 0


def test_url_templates_reject_the_impure_branch(spark):
    rng = random.Random(2)
    rows, bad = [], []
    for i in range(600):
        part = rng.choice(["news", "blog", "spam"])
        rows.append((i, f"http://h.org/{part}/{i}.html"))
        if i % 2:
            bad.append((i, part == "spam" if rng.random() < 0.95 else part != "spam"))
    got = url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad boolean"), RULES).collect()
    assert all((r.verdict == "block") == r.path.startswith("/spam/") for r in got)
    assert {r.template for r in got} == {"h.org/spam/*", "h.org/*/*"}


def test_url_templates_test_a_branch_against_many_small_siblings(spark):
    urls = [f"http://h.org/spam/{i}" for i in range(100)] + [f"http://h.org/slug-{chr(97 + i % 25)}{chr(97 + i // 25)}/{j}" for i in range(500) for j in range(1 + i % 4)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_templates.judge(pages, pages.selectExpr("page_id", "url like '%/spam/%' as bad"), []).collect()
    assert {r.path for r in got if r.verdict == "block"} == {f"/spam/{i}" for i in range(100)}
    assert {r.template for r in got} == {"h.org/spam/*", "h.org/*/*"}


def test_url_templates_grow_to_deep_branches_and_set_all_apart(spark):
    urls = [(f"http://deep.org/a/b/c/d/e/{part}/{i}", part == "spam") for part in ("spam", "news") for i in range(40)]
    share = {"a": 100, "b": 80, "c": 55, "d": 30, "e": 0}
    urls += [(f"http://wide.org/{part}/{i}", i < n) for part, n in share.items() for i in range(100)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    marks = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls)], "page_id long, bad boolean")
    got = url_templates.judge(pages, marks, []).collect()
    assert {r.path.split("/")[6]: r.verdict for r in got if r.host == "deep.org"} == {"spam": "block", "news": "allow"}
    assert len({r.template for r in got if r.host == "wide.org"}) == 5


def brute_templates(marks):
    """Template of each (path, bad); one host, all labelled: branches of a node are cut in two until none differs from the others."""
    def branch(segment):
        stem, ext = re.fullmatch(r"(.*?)(\.[A-Za-z]{1,5})?", segment, re.S).groups("")
        for pattern, kind in ((r"[0-9]+", "<n>"), (r"(?=.*[0-9])[0-9a-fA-F-]{8,}", "<h>"), (r".*[0-9].*|.{41,}", "<v>")):
            if re.fullmatch(pattern, stem):
                return kind + ext
        return segment

    def cut(members, at):
        n, bad = (sum(m[i] for m in members.values()) for i in (0, 1))
        z = {}
        for name, (l, b) in members.items():
            if l >= 5 and n - l >= 5 and 0 < bad < n:
                p = bad / n
                z[name] = (b / l - (bad - b) / (n - l)) / math.sqrt(p * (1 - p) * (1 / l + 1 / (n - l)))
        far = {name: x for name, x in z.items() if abs(x) > 2.58}
        if not far:
            label = "*" if "1" not in at else next(iter(members)) if len(members) == 1 else "*" + at
            return dict.fromkeys(members, label)
        up = max(far.values(), key=abs) > 0
        one = {name for name, x in far.items() if (x > 0) == up}
        parts = ({k: v for k, v in members.items() if (k in one) == s} for s in (True, False))
        return {k: v for p, a in zip(parts, ("1", "0"), strict=True) for k, v in cut(p, at + a).items()}

    found = [""] * len(marks)
    split = [p.removeprefix("/").split("/") for p, _ in marks]
    for level in range(max(map(len, split))):
        nodes = {}
        for i, s in enumerate(split):
            if len(s) > level:
                nodes.setdefault(found[i], []).append(i)
        for rows in nodes.values():
            members = {}
            for i in rows:
                m = members.setdefault(branch(split[i][level]), [0, 0])
                m[0] += 1
                m[1] += marks[i][1]
            label = cut(members, "")
            for i in rows:
                found[i] += "/" + label[branch(split[i][level])]
    return found


def test_url_templates_agree_with_a_tree_by_brute_force(spark):
    rng = random.Random(5)
    share = {name: rng.choice([0.02, 0.02, 0.5, 0.95]) for name in "abcdefghijkl"}
    marks = []
    for i in range(1500):
        a, b = rng.choice("abcdefghijkl"), rng.choice(["x", "y", "z-9", "20", "p.html"])
        bad = rng.random() < (1 - share[a] if b == "y" and a in "abc" else share[a])
        marks.append((f"/{a}/{b}" + f"/{i}" * rng.randrange(2), bad))
    pages = spark.createDataFrame([(i, "http://h.org" + p) for i, (p, _) in enumerate(marks)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(marks)], "page_id long, bad boolean")
    want = brute_templates(marks)
    got = {r.page_id: (r.template, r.purity, r.verdict) for r in url_templates.judge(pages, labels, []).collect()}
    assert [got[i][0] for i in range(len(marks))] == ["h.org" + t for t in want]
    first = {t.split("/")[1] for t in want}
    assert any(t.startswith("*") and t != "*" for t in first) and len(first) < len(share)  # some branches are merged beside the rest
    prior = (sum(not b for _, b in marks) + 8 * sum(not b for _, b in marks) / len(marks)) / (len(marks) + 8)
    for i, t in enumerate(want):
        same = [b for (_, b), u in zip(marks, want, strict=True) if u == t]
        purity = (same.count(False) + 8 * prior) / (len(same) + 8)
        assert abs(got[i][1] - purity) < 1e-9 and got[i][2] == ("block" if purity < 0.5 else "allow")


def test_secret_scan(spark, make_docs, odd):
    rng = random.Random(3)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows, planted = [], set()
    for i in range(400):
        words = ["".join(rng.choices("aeiounrstlhd", k=rng.randint(3, 20))) for _ in range(30)]
        if i % 10 == 0:
            words[rng.randrange(29)] = rng.choice([f"password={hexes(18)}", "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)), f'token = "{hexes(40)}"'])
            planted.add(i)
        if i % 10 == 5:
            words[3] = "".join(rng.choices("0123456789", k=16))
        rows.append((i, " ".join(words)))
    got = secret_forest.scan(make_docs(rows)).collect()
    assert {r.doc_id for r in got if r.is_secret} == planted
    assert {(r.doc_id, r.position) for r in got} == {(i, p) for i, t in rows for p, w in enumerate(t.split(" ")) if __import__("re").search(secret_forest.RUN, w)}
    assert secret_forest.scan(odd).filter("is_secret").count() == 0
    assert secret_forest.scan(make_docs([])).count() == 0


def test_secret_scan_judges_each_run_of_a_word(spark, make_docs):
    import hashlib
    import re

    aws, github, jwt = "AKIA" + "Q7" * 8, "ghp_" + "aB3d" * 9, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9"
    texts = [f'{{"a":"{aws}","b":"{github}"}}', f"see https://h.org/a-long-url-path-segment?key={aws}&next={github} there", f"token={jwt}", f'{{"secret":"{jwt}","identifier":"12345678901234567"}}', f"plain {github}"]
    found = secret_forest.candidates(make_docs(list(enumerate(texts)))).collect()
    want = {(i, p, k, m) for i, t in enumerate(texts) for p, w in enumerate(t.split(" ")) for k, m in enumerate(re.findall(secret_forest.RUN, w))}
    assert {(r.doc_id, r.position, r.run_index, r.run) for r in found} == want and len(found) == len(want)
    before = {(r.doc_id, r.run): r.before for r in found}
    assert before[0, github] == '"b":"' and before[1, github] == "next=" and before[3, "12345678901234567"] == '"identifier":"'
    assert before[2, jwt.split(".")[2]] == "token=" + ".".join(jwt.split(".")[:2]).lower() + "."
    got = secret_forest.scan(make_docs([(i, texts[i % 5] if i % 4 == 0 else "internationalisations of words") for i in range(200)])).collect()
    judged = {r.run_sha256: r.is_secret for r in got}
    assert judged[hashlib.sha256(aws.encode()).hexdigest()] and judged[hashlib.sha256(github.encode()).hexdigest()]
    assert len(got) == len({(r.doc_id, r.position, r.run_index) for r in got})


def test_pipeline(spark, make_docs, tmp_path):
    import corpus_pipeline
    from namewright.llm import compression_language, grace_dedup, partenum

    from .test_documents import language_docs

    rows = [(i, t, lang, "ab"[i % 2]) for i, t, lang in language_docs(120)]
    rows += [(200, rows[3][1], "aa", "a"), (201, None, "aa", "b"), (202, "12 34", "aa", "b")]
    docs = make_docs(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    first = spark.read.parquet(f"{tmp_path}/language_id")
    assert {201, 202}.isdisjoint({r.doc_id for r in first.collect()})
    assert spark.read.parquet(f"{tmp_path}/exact_dedup").filter("doc_id = 200").count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert all(f is not None for f in (compression_language, grace_dedup, partenum))
