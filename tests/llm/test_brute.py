"""The methods against plainer versions of themselves, in plain Python over whole texts."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, language, license_scan, pii, quality_model, quality_rules
from plumbline.llm import queries as llm

WORD = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_queries_are_their_sql(name, same_as_sql):
    assert same_as_sql(llm.QUERIES[name], llm.ORACLES[name])


def documents(spark, small, most=400):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(most).collect()]


# --- op5: naive Bayes support vectors ---


def shape(word):
    out = re.sub(r"[A-ZÀ-ÖØ-Þ]+", "A", word)
    out = re.sub(r"[a-zß-öø-ÿ]+", "a", out)
    return re.sub(r"[^A-Za-z0]{2,}", "##", re.sub(r"[0-9]+", "0", out))


def brute_features(text):
    words = re.findall(WORD, text or "")
    shapes = [shape(w) for w in words]
    pairs = list(itertools.pairwise(range(len(words))))
    found = {("w", w) for w in words} | {("s", s) for s in shapes}
    found |= {("ww", words[i], words[j]) for i, j in pairs} | {("ss", shapes[i], shapes[j], words[i] == words[j]) for i, j in pairs}
    return found


def brute_model(rows, labels):
    """Weights by feature, bias and the logistic curve, from sets of n-grams themselves rather than hashed places."""
    y = [1.0 if v == 1 else -1.0 for v in labels]
    places = 1 << quality_model.BITS
    counts = {s: collections.Counter(f for r, v in zip(rows, y, strict=True) if v == s for f in r) for s in (1.0, -1.0)}
    total = {s: places * quality_model.SMOOTH + sum(counts[s].values()) for s in counts}
    ratio = {f: math.log((quality_model.SMOOTH + counts[1.0][f]) / total[1.0]) - math.log((quality_model.SMOOTH + counts[-1.0][f]) / total[-1.0]) for r in rows for f in r}
    values = [{f: ratio[f] / math.sqrt(max(len(r), 1)) for f in r} for r in rows]
    squares = [sum(v * v for v in x.values()) + 1 for x in values]
    limit = {s: quality_model.COST * len(y) / (2 * y.count(s)) for s in (1.0, -1.0)}
    weight, bias, alpha = collections.defaultdict(float), 0.0, [0.0] * len(rows)
    order = np.random.default_rng(quality_model.SEED)
    for _ in range(quality_model.EPOCHS):
        for i in order.permutation(len(rows)):
            gradient = y[i] * (sum(weight[f] * v for f, v in values[i].items()) + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), limit[y[i]])
            step, alpha[i] = (new - alpha[i]) * y[i], new
            for f, v in values[i].items():
                weight[f] += step * v
            bias += step
    margins = [sum(weight[f] * v for f, v in x.items()) + bias for x in values]
    high, low = (y.count(1.0) + 1) / (y.count(1.0) + 2), 1 / (y.count(-1.0) + 2)
    slope, shift = 1.0, 0.0
    for _ in range(30):
        p = [1 / (1 + math.exp(-max(-30, min(30, slope * m + shift)))) for m in margins]
        d = [a - (high if v > 0 else low) for a, v in zip(p, y, strict=True)]
        q = [a * (1 - a) + 1e-9 for a in p]
        h = [[sum(a * m * m for a, m in zip(q, margins, strict=True)) + 1e-3, sum(a * m for a, m in zip(q, margins, strict=True))], [sum(a * m for a, m in zip(q, margins, strict=True)), sum(q) + 1e-3]]
        change = np.linalg.solve(h, [sum(a * m for a, m in zip(d, margins, strict=True)) + 1e-3 * (slope - 1), sum(d)])
        slope, shift = slope - change[0], shift - change[1]

    def score(found):
        margin = sum(weight[f] * ratio[f] for f in found if f in ratio) / math.sqrt(max(len(found), 1)) + bias
        return 1 / (1 + math.exp(-max(-30, min(30, max(slope, 1e-3) * margin + shift))))

    return score


def test_scores_are_those_of_the_plain_model(spark):
    rng = random.Random(4)
    good, bad = [f"word{i}" for i in range(40)], ["BUY!!", "now$$", "win", "cash", "$$$", "click"]
    text = lambda quality: " ".join(rng.choice(good if rng.random() < (0.9 if quality else 0.5) else bad) for _ in range(rng.randint(3, 25)))
    rows = [(i, text(i % 2)) for i in range(60)] + [(60, ""), (61, None), (62, "unseen words alone")]
    labels = [(i, i % 2) for i in range(60)] + [(3, 1), (3, 1), (200, 1)]  # repeated, and of a document that is not there
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    training = [(i, t, i % 2) for i, t in rows[:60] if zlib.crc32(str(i).encode()) % 3 != 1]
    plain = brute_model([brute_features(t) for _, t, _ in training], [v for *_, v in training])
    out = {r.doc_id: r.score for r in quality_model.scored(docs, quality_model.train(docs, given)).collect()}
    for i, t in rows:
        assert out[i] == pytest.approx(plain(brute_features(t)), abs=2e-3), i  # hashed places of 2^20, and single precision
    few = quality_model.train(docs, given, max_features=200)
    assert len(quality_model.scored(docs, few).collect()) == len(rows)


# --- op8: out-of-place distance ---


def profile(texts, top=language.TOP):
    found = collections.Counter()
    for text in texts:
        padded = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
        if not padded.strip():
            continue
        for n in (1, 2, 3):
            found.update(g for i in range(len(padded) - n + 1) if not (g := padded[i : i + n]).isspace() and not (n == 3 and g[1] == " "))
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:top]]


def test_languages_are_those_of_the_plain_distance(spark, small):
    rows = documents(spark, small, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = collections.defaultdict(list)
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            known[lang].append(text)
    profiles = {lang: {g: k for k, g in enumerate(profile(texts))} for lang, texts in known.items()}
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.train(docs)).collect()}
    for i, text, _ in rows:
        own = profile([text])
        apart = {lang: sum(abs(p[g] - k) if g in p else language.TOP for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=lambda lang: apart[lang])
        assert out[i] == (best, pytest.approx(1 - apart[best] / (language.TOP * len(own))))


# --- op9: lines that fail, and what a text loses by them ---


def brute_lost(text):
    lost = total = 0
    seen = set()
    for line in text.split("\n"):
        words, bare = re.findall(WORD, line), line.strip(" \t\x0b\x0c\r\n")
        n, size = len(words), len(line.encode())
        total += len(bare.encode())
        letters = [c for c in line if c.isascii() and c.isalpha()]
        fails = n > 0 and (
            line in seen
            or (line.count("|") >= 2 and 3 * line.count("|") >= n)
            or sum(c in "#*$%&|<>" for c in line) > 0.08 * size
            or (n >= 4 and bool(letters) and all(c.isupper() for c in letters) and 2 * line.count("!!") >= n)
            or (n < 5 and not line.rstrip(" \t\x0b\x0c\r\n").endswith(tuple(".!?:;\"')]…”»。")))
            or (n >= 10 and 4 * len(set(words)) <= n)
            or (n <= 12 and any(p.decode() in line.lower() for p in quality_rules.BOILERPLATE))
        )
        seen.add(line)
        lost += len(bare.encode()) * fails
    return lost / total if total else 0.0


def test_verdicts_are_those_of_plain_rules(spark, small):
    rng = random.Random(9)
    lines = ["An ordinary line of prose that says what it says.", "Home | News | About", "BUY!! IT!! ALL!! NOW!!", "short", "to%% be** or## not$$", "Accept our cookie policy.", "a a a a a a a a a a a a.", "", "  ", "é ü ö — ß", "Read more", "x " * 200 + "."]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [t or "" for _, t, _ in documents(spark, small, 150)]
    out = {r.doc_id: r for r in quality_rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert out[i].lost == pytest.approx(brute_lost(text)), text
        assert out[i].kept == (not out[i].base_failed and out[i].lost <= quality_rules.MAX_LOST)


# --- op7: notices planted among other words ---


def test_planted_notices_are_found_where_they_are(spark):
    rng = random.Random(6)
    templates = license_scan.TEMPLATES
    scanner = license_scan.Scanner(templates)
    rows, want = [], []
    for i in range(150):
        words, spans = [], []
        for _ in range(rng.randint(0, 4)):
            words += [f"filler{rng.randrange(50)}" for _ in range(rng.choice((0, 0, 3, 40)))]
            name = rng.choice(sorted(templates))
            copy = templates[name].split()
            for _ in range(int(0.05 * len(copy))):  # half of what a match may lack, elsewhere than at its ends
                copy[rng.randrange(1, len(copy) - 1)] = "changed"
            spans.append((len(words), len(words) + len(copy), name))
            words += copy
        rows.append((i, " ".join(words)))
        want.append(spans)
    out = {r.doc_id: r.matches for r in license_scan.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, spans in enumerate(want):
        found = [(m.start, m.end, m.name) for m in out[i]]
        assert [(s, e) for s, e, _ in found] == [(s, e) for s, e, _ in spans], rows[i]
        # a notice may be the same words as another's beginning
        assert all(a[2] == b[2] or scanner.templates[a[2]] == scanner.templates[b[2]] for a, b in zip(found, spans, strict=True))


def test_thousands_of_copies_in_one_text():
    notice = license_scan.TEMPLATES["mit"].split()
    words = [license_scan.bare(w) for w in notice] * 5000
    assert len(license_scan.Scanner(license_scan.TEMPLATES).scan(words)) == 5000


# --- op4: patterns induced, scored and used ---


def brute_discovery(texts):
    """Spans by plain loops over mentions, patterns and forms."""
    patterns = {k: re.compile({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}[k]) for k in pii.KINDS}
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
    holds = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    other = re.compile(r"(?<![0-9A-Za-z(])\(?[0-9][0-9(). -]*[0-9](?![0-9A-Za-z])|(?<![^\x20\x09-\x0D])[^@\x20\x09-\x0D]+@[^\x20\x09-\x0D]+|(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])")
    mentions = []  # (text, kind, start, end, form, patterns)
    for t, text in enumerate(texts):
        base = [(k, m.start(), m.end()) for k in pii.KINDS for m in patterns[k].finditer(text) if holds[k](m[0])]
        rest = [(None, m.start(), m.end()) for m in other.finditer(text) if len(digits(m[0])) >= 7 or "@" in m[0] or ":" in m[0]]
        rest = [x for x in rest if not any(b[1] < x[2] and x[1] < b[2] for b in base)]
        for k, a, b in base + rest:
            before, after = re.findall(WORD, text[:a].lower()), re.findall(WORD, text[b:].lower())
            own = [f"1 {before[-1]}"] if before else []
            own += [f"2 {before[-2]} {before[-1]}"] if len(before) > 1 else []
            own += [f"3 {before[-1]} {after[0]}"] if before and after else []
            mentions.append((t, k, a, b, text[a:b].lower(), own))
    edges = collections.defaultdict(set)
    for _, k, _, _, form, own in mentions:
        for p in own:
            edges[p, form].add(k)
    seed = {e: {k: float(k in kinds) for k in pii.KINDS} for e, kinds in edges.items()}
    known = {e for e, kinds in edges.items() if kinds - {None}}
    of_pattern = collections.defaultdict(list)
    for p, form in edges:
        of_pattern[p].append(form)

    def pattern_scores(score):
        return {p: {k: sum(seed[p, f][k] if score is None or (p, f) in known else score.get(f, {}).get(k, 0.0) for f in forms) / (len(forms) + 0.5) for k in pii.KINDS} for p, forms in of_pattern.items()}

    scores = pattern_scores(None)
    for _ in range(pii.ROUNDS - 1):
        reached = collections.defaultdict(list)
        for p, f in edges:
            if (p, f) not in known:
                reached[f].append(scores[p])
        scores = pattern_scores({f: {k: sum(s[k] for s in found) / len(found) for k in pii.KINDS} for f, found in reached.items()})
    seeds = {p: {k: sum(seed[p, f][k] for f in forms) for k in pii.KINDS} for p, forms in of_pattern.items()}
    fits = {"email": lambda f: re.match(r"[^@]*[a-z0-9][^@]*@[^@]*[a-z0-9]", f), "ip": lambda f: re.fullmatch(r"[0-9a-f]{1,4}(:[0-9a-f]{0,4}){3,7}", f) or re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", f), "card": lambda f: 13 <= len(digits(f)) <= 19 and re.fullmatch(r"[0-9 -]+", f), "phone": lambda f: 7 <= len(digits(f)) <= 15 and re.fullmatch(r"[0-9(). -]+", f)}
    out = [sorted((pii.KINDS.index(m[1]), m[2], m[3]) for m in mentions if m[0] == t and m[1]) for t in range(len(texts))]
    for t, k, a, b, form, own in mentions:
        won = [(scores[p][j], -i) for p in own for i, j in enumerate(pii.KINDS) if k is None and fits[j](form) and scores[p][j] >= pii.MIN_SCORE and seeds[p][j] >= pii.MIN_SEEDS]
        if won:
            out[t] = sorted([*out[t], (-max(won)[1], a, b)])
    return out


def test_discovered_spans_are_those_of_plain_loops(spark, small):
    rng = random.Random(12)
    parts = ["call", "hotline", "at", "mail", "to", "host", "card", "no", "+49 30 555-{:04d}", "030 555 {:04d}", "user{}@example.org", "user{}@host", "10.0.{}.9", "10.0.{}.900", "4111 1111 1111 1111", "fe80:0:0:{}", "\n", "  " * 40, "w" * 300, ";", "a@b.c;d@e.f"]
    texts = [" ".join(rng.choice(parts).format(rng.randrange(200)) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += [f"please call hotline +49 30 555-{i:04d} today" for i in range(30)] + [f"please call hotline 030 555 {i:04d} today" for i in range(20)] + ["", "x " * 3000 + "call hotline 030 555 9999 now"]
    long = ["k" * 290 + str(i) for i in range(3)] + ["l" * 1500 + str(i) for i in range(2)]  # words that differ beyond 256 characters
    texts += [f"{a} {b} {number} {c}" for i, number in enumerate(["+49 30 555-1234", "030 555 1234"]) for a in long for b in [*long, "id"] for c in (long[i], "end")]
    texts += [t or "" for _, t, _ in documents(spark, small, 200)]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute_discovery(texts)
    assert [found[i] for i in range(len(texts))] == want and any(len(w) > len([s for s in w if s]) - 1 for w in want)


def test_many_mentions_in_one_text(spark):
    text = " ".join(f"mail user{i}@example.org or 030 555 {i:04d}," for i in range(4000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert len(pii.find(docs).first().base) == 4000
    assert pii.redact(docs).first().text.count("[email]") == 4000


# --- op2: rows that share an id, and recall with partitions left out ---


def test_rows_that_share_an_id_are_ranked_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.8, 0.0]), (2, [0.1, 1.0])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).collect()
    found = sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in out)
    assert found == sorted([(1, 0, 0.9), (2, 1, 0.8), (3, 2, 0.1), (1, 0, 0.9), (2, 1, 0.72), (3, 2, 0.19)])


def test_recall_of_twenty_with_partitions_left_out(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24)) * 2
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 24))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(set)
    for r in ann.search(docs, F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argpartition(-score, 20)[:20].tolist()))
    assert hits / (20 * 300) >= 0.95
