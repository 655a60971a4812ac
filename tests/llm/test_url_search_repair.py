"""Operators 11 to 13 against brute force, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lakeshore.llm import dialog_repair as dr
from lakeshore.llm import queries as Q
from lakeshore.llm import ranked_search as rs
from lakeshore.llm import url_filters as uf

# ---------------------------------------------------------------- 11 URL filters

SITES = [(r.name, r.verdict) for r in uf.SITE_RULES]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:at], rest[at:]
    path = re.split("[?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def judge(url):
    host, path = split_url(url)
    best = None
    for site, verdict in SITES:
        name, _, start = site.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            if best is None or len(site) > len(best[0]):
                best = site, verdict
    if best:
        return host, path, *best
    spam = set(re.split("[^A-Za-z0-9]", host)) & set(uf.SPAM_WORDS)
    return host, path, None, "block" if spam else "allow"


def odd_urls():
    rng = random.Random(5)
    out = [None, "", "no scheme", "://", "http://", "http://org", "http://org/", "HTTP://A.Org/x", "http://xorg/", "http://.org/",
           "http://example.org/es/", "http://example.org/es", "http://m.EXAMPLE.org/en/1", "http://notexample.org/en/15",
           "http://example.org/en/15?q=/es/", "http://a.com/fr/#x", "http://a.com/de/", "http://a.com?x=/fr/", "http://a.com:80/fr/",
           "x://y://org/", "http://É.com/fr/é", "http://casino-win.example.net/en/1", "http://a.net/casino-win", "http://a\nb.org/\n",
           "http://my.casinos.net/", "http://bets.net", "http://a.com/fr" + "/x" * 20000]
    hosts = ["example.org", "a.example.org", "b.com", "free-bets.net", "ORG", "com"]
    for _ in range(200):
        out.append(f"https://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/en/1', '/fr/', '/de/', '/de'])}{rng.choice(['', 'x', '?q', '#'])}")
    return out + out[:40]


def test_urls_equal_brute_force(spark):
    urls = odd_urls()
    pages = spark.createDataFrame([(k if k % 9 else None, u, "t") for k, u in enumerate(urls)], "page_id long, url string, text string")
    pages = pages.withColumn("rule", F.lit(1)).withColumn("token", F.lit(2)).withColumn("host", F.lit("z")).repartition(3)
    rules = uf.rule_table(spark, uf.SITE_RULES + uf.SPAM_RULES)
    got = uf.judge(pages, rules).select("page_id", "host", "path", F.when(F.col("tier") == 0, F.col("rule")), "verdict").collect()
    want = [(k if k % 9 else None, *judge(u)) for k, u in enumerate(urls)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert uf.judge(pages.limit(0), rules).collect() == []


def test_rules_stand_under_their_rarest_token_and_no_rule_is_missed(spark):
    rng = random.Random(8)
    parts = ["ab", "cd", "ad", "x1", "y2", "-", ".", "/", "_"]
    patterns = ["||" + "".join(rng.choice(parts) for _ in range(3)) for _ in range(15)]
    patterns += ["".join(rng.choice([*parts, "*", "^"]) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    patterns += ["|ab", "ab|", "|ab.cd/x1|", "/a[bd].*x/", "*", "^"]
    patterns = [p for p in dict.fromkeys(patterns) if not re.fullmatch("/.*/", p) or p == "/a[bd].*x/"]
    rules = [uf.Rule(p, p, "block") for p in patterns]
    urls = ["http://" + "".join(rng.choice(parts[:6]) for _ in range(2)) + "." + rng.choice(parts[:4])
            + rng.choice(["", "/" + "".join(rng.choice(parts) for _ in range(3))]) for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule for r in uf.judge(pages, uf.rule_table(spark, rules)).collect()}
    python = {p: re.compile(uf.regular_expression(p).replace(r"\z", r"\Z")) for p in patterns}
    for k, url in enumerate(urls):
        text = "".join(split_url(url))
        fits = [p for p in patterns if python[p].search(text)]
        assert got[k] == min(fits, key=lambda p: (-len(p), p), default=None), (url, fits)
    tokens = spark.createDataFrame([(["common", "rare"],), (["common"],)], "tokens array<string>")
    table = uf.rule_table(spark, [uf.Rule("a", "^common^rare^", "block"), uf.Rule("b", "^common^", "block"), uf.Rule("c", "co*", "block"),
                                  uf.Rule("d", "^absent^common^", "block")])
    index = {r.rule: r.token for r in uf.rarest_token_index(table, tokens).collect()}
    assert index == {"a": "rare", "b": "common", "c": uf.ANY, "d": "absent"}


# ---------------------------------------------------------------- 12 ranked search

def lexical_terms(text):
    folded = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [t for t in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded) if t]


def brute_ranking(docs, items, top=10):
    bags = [(d, Counter(lexical_terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    big_n, big_l = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out, wanted = [], defaultdict(set)
    for i, t in items:
        wanted[i] |= set(lexical_terms(t))
    for i, query in wanted.items():
        scores = []
        for d, b, n in bags:
            m = 100 - 90 + (90 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
                    for t in query if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_ranking_equals_brute_force(spark, monkeypatch, small):
    if small:       # many pieces, blocks, buckets and groups of queries
        for name, value in (("PIECE", 64), ("BLOCK_ROWS", 40), ("BUCKET_ROWS", 8), ("GROUP_TERMS", 60)):
            monkeypatch.setattr(rs, name, value)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(120)] + ["Ümlaut", "ñ", "a\u00a0b"]
    line = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocab).title() for _ in range(n))
    docs = [(k, line(rng.randrange(1, 60))) for k in range(300)] + [(None, "w1 w2"), (None, None), (900, None), (901, ""), (902, "!?")]
    docs += [(1000 + k, "w5 w6 w7 copies") for k in range(60)] + [(7, "w5 w6 w7 copies")] * 3 + [(903, line(20000)), (904, "\x00W9\x00")]
    items = [(k, line(rng.randrange(1, 12))) for k in range(25)] + [(100, None), (101, ""), (102, "nowhere"), (103, "copies"), (103, "w9 w9"),
                                                                    (None, "w1 w1 copies"), (104, "copies"), (104, "copies")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("terms", F.lit("z")).repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("n", F.lit(2))
    got = sorted(map(str, map(tuple, rs.search(d, i).collect())))
    assert got == sorted(map(str, brute_ranking(docs, items)))


def test_ranking_of_empty_tables_has_no_rows(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, items in ((d.limit(0), i), (d, i.limit(0)), (d, i.filter("false"))):
        out = rs.search(docs, items)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []


def test_buckets_and_coordinates_prune_without_loss():
    rng = np.random.default_rng(2)
    rows, terms_ = 4000, 200
    size = rng.integers(1, 40, rows)
    start = np.append(0, np.cumsum(size))
    term = np.concatenate([rng.choice(terms_, s, replace=False) for s in size])
    value = rng.integers(1, 1000, start[-1]) * np.repeat(rng.integers(1, 200, rows), size)
    length = np.sqrt(np.add.reduceat(value.astype(float) ** 2, start[:-1]))
    order = np.argsort(-length)
    buckets = []
    for k in range(0, rows, 100):
        pick = order[k:k + 100]
        at = np.concatenate([np.arange(start[i], start[i + 1]) for i in pick])
        buckets.append(rs.Bucket(pick.tolist(), np.append(0, np.cumsum(size[pick])), term[at], value[at], length[pick]))
    met = scored = 0
    for q in range(20):
        wanted = rng.choice(terms_, 6, replace=False)
        weights = rng.integers(1, 3000, 6)
        query = rs.Query(q, wanted, weights)
        for b in buckets:
            a, c = rs.search_bucket(query, b)
            met, scored = met + a, scored + c
        by = dict(zip(wanted.tolist(), weights.tolist()))
        exact = [sum(by.get(t, 0) * v for t, v in zip(term[a:b].tolist(), value[a:b].tolist())) for a, b in zip(start, start[1:])]
        want = sorted(((-s, d) for d, s in enumerate(exact) if s > 0))[:10]
        assert sorted((-s, d) for s, _, d in query.best) == want
    assert met < 0.8 * 20 * rows and scored < 0.3 * met        # whole buckets go, and most rows of the others


# ---------------------------------------------------------------- 13 conversation repair

COST = {"K": 0, "R": 2, "D": 3, "I": 2}


def plain_repair(rows):
    """Cheapest edits as plain strings, by a dynamic program from the last row on."""
    from functools import lru_cache

    @lru_cache(None)
    def rest(at, state, inserted):
        out = []
        if at == len(rows) and state in (0, 3):
            out.append((0, ""))
        for role in "ua":
            to = dr.STEP[role].get(state)
            if to is not None and inserted < 2:
                cost, text = rest(at, to, inserted + 1)
                out.append((cost + 2, "I" + text))
        if at < len(rows):
            initial, gone, cut = rows[at]
            cost, text = rest(at + 1, state, 0)
            out.append((cost + 3, "D" + text))
            if not gone:
                for edit, role in [("R", "u"), ("R", "a"), ("K", initial)]:
                    to = dr.STEP.get(role, {}).get(state)
                    if to is not None:
                        cost, text = rest(at + 1, to, 0)
                        out.append((cost + COST[edit] + cut, edit + text))
        return min(out, default=(10**9, ""))
    return rest(0, 0, 0)


def streamed(rows, final_every=None):
    repair, done = dr.Repair(), ""
    for k, (initial, gone, cut) in enumerate(rows):
        repair.row(initial, gone, cut)
        if final_every and k % final_every == 0:
            done += repair.final_prefix()
    cost, text = repair.last()
    return cost, done + text


def test_edits_are_cheapest_then_least():
    kinds = [(r, False, False) for r in "sua?"] + [("u", True, False), ("a", False, True)]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            assert streamed(rows) == plain_repair(rows), rows
    rng = random.Random(1)
    for _ in range(150):
        rows = tuple((rng.choice("suuuaaa?"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(rng.randrange(1, 60)))
        want = plain_repair(rows)
        assert streamed(rows) == want
        assert streamed(rows, 3) == want


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(dr, "PRIME", 2)          # nearly all hashes collide
    rng = random.Random(2)
    for _ in range(40):
        rows = tuple((rng.choice("sua?"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(rng.randrange(1, 30)))
        assert streamed(rows) == plain_repair(rows)


def test_a_long_conversation_leaves_the_task_as_it_goes():
    rng, repair, longest = random.Random(3), dr.Repair(), 0
    held = 0
    for _ in range(20_000):
        repair.row(rng.choice("uuaas"), rng.random() < 0.1, rng.random() < 0.1)
        held += 1
        if held % 64 == 0:
            held -= len(repair.final_prefix().replace("I", ""))
            longest = max(longest, held)
    assert longest < 256


def brute_conversations(rows):
    """The whole contract on plain Python rows (conv_id, turn, role, text)."""
    after = defaultdict(list)
    for c, t, role, text in rows:
        after[c]
        role, text = " " if role is None else role, " " if text is None else text
        cause = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if cause == 1:
            text = ""
        if cause == 2:
            text = re.sub("[.!?]", "", text)
        if cause == 4:
            role = "user"
        after[c] += [(t, role, text)] * {0: 0, 3: 2}.get(cause, 1)
    out = []
    for c, rest in after.items():
        rest.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for t, role, text in rest:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in rest if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rest, rest[1:]))
        cost, edits = plain_repair(tuple((r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rest, faults)))
        left, fixed = iter(rest), []
        for e in edits:
            _, role, text = (None, None, "") if e == "I" else next(left)
            if e in "IR":
                role = "assistant" if fixed and fixed[-1][0][:1] == "u" else "user"
            if e != "D":
                fixed.append((role, text))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha))
    return out


def odd_conversations():
    rng = random.Random(9)
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (1, None, "user", "A."), (1, None, "assistant", "B?"), (2, 5, "tool", "x."),
            (3, 1, "", "y."), (4, 1, "user", "\t "), (5, 1, "system", "Be nice."), (6, 1, "user", "ü" * 5000 + "."), (7, 3, "user", "a.\u00a0")]
    for c in range(10, 80):
        rows += [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "bot", None]),
                  rng.choice(["One.", "Two!", "Three? ", "cut off", "", " ", None, "x" * 50 + "."])) for t in range(rng.randrange(1, 14)) if rng.random() < 0.9]
    rows += [(200, rng.randrange(40), "user", rng.choice(["same.", "same"])) for _ in range(300)]         # tied turns, repeats
    return rows + rows[:20]


def test_conversations_equal_brute_force(spark, monkeypatch):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", F.lit("x")).withColumn(
        "copy", F.lit(1)).withColumn("id", F.lit(2)).repartition(3)
    want = sorted(map(str, brute_conversations(rows)))
    assert sorted(map(str, map(tuple, dr.damaged_and_audited(df).collect()))) == want
    assert dr.damaged_and_audited(df.limit(0)).collect() == [] and dr.repair(df.limit(0)).collect() == []


def test_small_steps_give_the_same(spark, monkeypatch):
    rows = odd_conversations()
    monkeypatch.setattr(dr, "OPEN_ROWS", 3)
    monkeypatch.setattr(dr, "OUT_ROWS", 2)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2)
    assert sorted(map(str, map(tuple, dr.damaged_and_audited(df).collect()))) == sorted(map(str, brute_conversations(rows)))


def test_repair_returns_valid_conversations(spark):
    df = spark.createDataFrame(odd_conversations(), "conv_id long, turn long, role string, text string")
    texts = defaultdict(list)
    for r in dr.repair(df).orderBy("conv_id", "step").collect():
        if r.role is not None:
            texts[r.conv_id].append((r.role, r.text, r.edit))
            assert r.text is not None and (r.text == "" or r.edit != "I")
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0][:1] for x in rows)) for rows in texts.values())


@pytest.mark.parametrize("name", ["op11_url_filters", "op12_norm_buckets", "op13_dialog_repair"])
def test_columns_of_the_queries(spark, name):
    columns = {"op11_url_filters": "page_id host path rule verdict", "op12_norm_buckets": "item_id rank doc_id score",
               "op13_dialog_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"}
    assert Q.QUERIES[name](spark, SF_SMALL).columns == columns[name].split()
