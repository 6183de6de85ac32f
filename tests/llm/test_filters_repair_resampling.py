"""URL filters, conversation repair and importance resampling against brute force, and their edge cases."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from retentio.llm import repair, resampling, url_filter

# URL filters

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URLS = [None, "", "no scheme", "://", "http://", "https://example.net/en/x", "https://EXAMPLE.net/EN/x", "http://a.b.example.net/en/?q=://z/",
        "http://notexample.com/de/", "http://example.com/de/", "http://www.example.com/de", "http://x.org/fr/#a", "http://x.net", "http://x.net/",
        "http://x.net?a/b", "ftp://net/", "http://net./", "http://.net/a", "http://é.net/ü", "http://ÀÉ.Net/", "http://a.net/" + "x" * 100_000,
        "http://" + "a." * 5_000 + "org/fr/", "http://user@example.net:80/en/", "x://y://example.net/en/", "http://a\nb.net/\nz"]


def plain_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), raw)
        path = re.match(r"[^?#]*", rest[len(raw):]).group()
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def judged(spark, urls, rules, **options):
    pages = spark.createDataFrame([(k % 7 or None, u, "x", "y", "z") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string, found string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    return pages, url_filter.judge(pages, listed, **options)


@pytest.mark.parametrize("options", [{}, {"max_bytes": 8}], ids=["file", "parts"])
def test_url_filters(spark, options):
    pages, got = judged(spark, URLS + URLS[:6], RULES, **options)
    want = Counter((k % 7 or None, *plain_judge(u, RULES)) for k, u in enumerate(URLS + URLS[:6]))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]


@pytest.mark.parametrize("options", [{}, {"max_bytes": 2_000}], ids=["file", "parts"])
def test_url_filters_many_rules(spark, options):
    r = random.Random(5)
    host = lambda: ".".join(r.choices("abc", k=r.randint(1, 4)))
    path = lambda: "/" + "".join(r.choices("xy/", k=r.randint(0, 4)))
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((host(), r.choice(["", path()])) for _ in range(300))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(600)]
    _, got = judged(spark, urls, rules, **options)
    assert Counter(tuple(r) for r in got.collect()) == Counter((k % 7 or None, *plain_judge(u, rules)) for k, u in enumerate(urls))


def test_url_filters_lists(spark):
    odd = [(None, "/", "block"), ("", "/", "block"), ("a.net", None, "allow"), ("A.net", "", "block"), ("b.net", "/", "other")]
    _, got = judged(spark, ["http://a.net/q", "http://b.net/q"], odd)
    assert sorted((r.rule or "", r.verdict) for r in got.collect()) == [("", "allow"), ("a.net", "block")]
    assert judged(spark, [], RULES)[1].count() == 0
    assert {r.verdict for r in judged(spark, URLS, [])[1].collect()} == {"allow"}


def test_url_filters_confirm_strings(monkeypatch):
    """With a digest that collides all the time, the stored strings still decide."""
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b, *_: len(b) % 3)
    array = url_filter.DigestArray(np.frombuffer(url_filter.DigestArray.build([(h, p, v == "block") for h, p, v in RULES]), np.uint8))
    urls = ["http://x.net/", "http://example.net/en/", "http://qqq/", "http://abcdef.org/fr/"]
    split = [plain_judge(u, RULES) for u in urls]
    assert list(zip(*url_filter.probe(array, [s[0] for s in split], [s[1] for s in split]))) == [s[2:] for s in split]


# Conversation repair


def plain_cheapest(rows):
    """Uniform-cost search over all edits; of equal cost the ASCII-least audit."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, told = heapq.heappop(heap)
        if (at, told) in done:
            continue
        done.add((at, told))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", told):
            return cost, audit
        short = lambda t: t if len(t) < 4 else ("sua" if t[-1] == "a" else "suau")
        # what has been told only matters by its end
        push = lambda c, e, a, t: heapq.heappush(heap, (cost + c, audit + e, a, short(t))) if re.fullmatch("s?(ua)*u?", t) else None
        if len(audit) < 2 * len(rows) + 3:
            for new in "ua":
                push(3, "I", at, told + new)
        if at < len(rows):
            initial, fault = rows[at]
            push(4, "D", at + 1, told)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if initial:
                    push(more, "K", at + 1, told + initial)
                for new in "ua":
                    push(3 + more, "R", at + 1, told + new)


def test_search_is_cheapest():
    r = random.Random(11)
    for _ in range(800):
        rows = [(r.choice("suauax "), r.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(r.randint(0, 9))]
        assert repair.cheapest(rows) == plain_cheapest(rows), rows


def test_search_long():
    r = random.Random(2)
    rows = [(r.choice("uauauasx"), r.choice(["", "", "", "", "blank", "truncated"])) for _ in range(1_000)]
    cost, audit = repair.cheapest(rows)
    assert audit.count("I") + len(rows) == len(audit) and cost >= repair.bounds(rows)[0][0]


CHAT = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi there."), (1, 2, "assistant", "Hello!"), (1, 3, "assistant", "Hello!"),
        (2, None, "user", "a null turn?"), (2, 5, "assistant", "cut off"), (2, 9, "user", None), (3, 0, None, "no role."), (3, 1, "", "empty role."),
        (None, 0, "user", "no id."), (None, 1, "assistant", "x" * 50_000 + "."), (4, 0, "user", " \t\n"), (5, 1, "user", "same."), (5, 1, "user", "same."), (5, 1, "tool", "tie.")]


def plain_report(rows, damage=True):
    out, kept = {}, {}
    for conv, turn, role, text in rows:
        mine = kept.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if code:
            role = "user" if code == 4 else role
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            mine += [(turn, role, text)] * (2 if code == 3 else 1)
    for conv, mine in kept.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0], hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in mine:
            body = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in mine if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        cost, audit = plain_cheapest([(m[1][:1], f) for m, f in zip(mine, faults)])
        told, at = [], 0
        for e in audit:
            nxt = "assistant" if told and told[-1][0] == "user" else "user"
            if e == "I":
                told.append((nxt, ""))
                continue
            _, role, text = mine[at]
            at += 1
            if e != "D":
                # a kept role only counts by its initial
                told.append((role if e == "K" else nxt, text))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in told).encode()).hexdigest())
    return out


@pytest.mark.parametrize("damage", [True, False])
def test_repair(spark, damage):
    r = random.Random(8)
    rows = CHAT + [(100 + c, t, r.choice(["user", "assistant", "assistant", "user", "system"]), r.choice(["one.", "two!", "three", "four?"])) for c in range(60) for t in range(r.randint(1, 8))]
    told = spark.createDataFrame([(*x, "a", "b") for x in rows], "conv_id long, turn long, role string, text string, digest string, kind string")
    source = told.select("conv_id", "turn", "role", "text")
    got = {x[0]: tuple(x)[1:] for x in repair.report(repair.damaged(told) if damage else told).collect()}
    assert got == plain_report([tuple(x) for x in source.collect()], damage)
    empty = told.where("false")
    assert repair.report(repair.damaged(empty)).count() == 0 and repair.repaired(empty).count() == 0


def test_repaired_rows(spark):
    told = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    turns = {}
    for x in sorted(repair.repaired(told).collect(), key=lambda x: x.place):
        turns.setdefault(x.conv_id, []).append((x.edit, x.role, x.text))
    assert turns[1] == [("K", "system", "Be kind."), ("K", "user", "Hi there."), ("K", "assistant", "Hello!")]
    for mine in turns.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in mine))


# Importance resampling


def test_crc_matrix():
    r = random.Random(4)
    some = [bytes(r.choices(range(256), k=k)) for k in [0, 1, 1, 2, 3, 3, 900, 5_000] + [r.randint(0, 40) for _ in range(500)]]
    assert resampling.crc32_all(some).tolist() == [zlib.crc32(x) for x in some]
    assert resampling.crc32_all([]).tolist() == []


def plain_resample(docs, target, max_run, buckets, least, percent):
    feats = lambda t: [" ".join(w[k:k + n]) for w in [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))]
                       for n in range(1, max_run + 1) for k in range(len(w) - n + 1)]
    cell = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(cell(f) for _, x in docs for f in feats(x)), Counter(cell(f) for x in target for f in feats(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for d, x in docs:
        f = feats(x)
        weight = sum(gain(cell(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        words = sum(" " not in y for y in f)
        rows.append([d, len(f), weight, score, None, words, hashlib.md5((x or "").encode()).hexdigest()])
    fit = sorted((x for x in rows if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0], x[6]))
    for k, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = k + 1
    return Counter(tuple(x[:5]) for x in rows)


@pytest.mark.parametrize("max_run", [1, 2])
def test_resampling(spark, max_run):
    r = random.Random(6)
    vocabulary = "alpha Beta gamma's 中文 éÉ x1 naïve İ _ a-b 9".split()
    docs = [(0, None), (1, ""), (2, "..."), (3, "y" * 70_000 + " z"), (None, "no id " * 20), (None, "no id " * 20), (7, "again " * 30), (7, "again " * 30), (7, "other " * 30)]
    docs += [(100 + k, " ".join(r.choices(vocabulary, k=r.randint(1, 90)))) for k in range(150)]
    target = [None, "alpha alpha", " ".join(r.choices(vocabulary[:4], k=200))]
    table = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], "doc_id long, text string, digest string, buckets string, rank int")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(table, wanted, max_run=max_run, buckets=50, percent=30)
    assert Counter(tuple(x) for x in got.collect()) == plain_resample(docs, target, max_run, 50, 20, 30)
    assert resampling.resample(table.where("false"), wanted).count() == 0
    none = resampling.resample(table, wanted.where("false"), percent=0).collect()
    assert len(none) == len(docs) and {x["rank"] for x in none} == {None}
