"""The learnt splitter against the method written out with dictionaries."""

import math
import random
import re
from collections import Counter
from functools import partial

import pytest
from pyspark.sql import functions as F

from slowtide.operators import splitter as S

OPEN, CLOSE = re.compile(r"""^["'(\[{]+"""), re.compile(r"""["')\]},;:]+$""")


def token(word):
    core = CLOSE.sub("", OPEN.sub("", word))
    end = "!" if re.search(r"[!?]$|\.\.$", core) else "." if core.endswith(".") else ""
    bare = re.sub(r"[.!?]+$", "", core).lower()
    kind = S.NUMBER if re.fullmatch(r"[-+]?[0-9][0-9.,]*", bare) else bare
    return kind, end, core[:1] != core[:1].lower(), core[:1] != core[:1].upper()


def tlog(n, p):
    return n * math.log(p) if n else 0.0


def pair_score(a, b, ab, n):
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    rest = n - a - b + ab
    alone = tlog(ab, p) + tlog(a - ab, 1 - p) + tlog(b - ab, p) + tlog(rest, 1 - p)
    joint = tlog(ab, p1) + tlog(a - ab, 1 - p1) + tlog(b - ab, p2) + tlog(rest, 1 - p2)
    return -2 * (alone - joint)


class Brute:
    def __init__(self, texts):
        rows = []
        for text in texts:
            own = [token(w) for w in text.split()]
            rows += [(t, own[i - 1] if i else None) for i, t in enumerate(own) if any(c.isalnum() for c in t[0])]
        dotted, plain = Counter(t[0] for t, _ in rows if t[1] == "."), Counter(t[0] for t, _ in rows if t[1] != ".")
        n, n_dotted = len(rows), sum(dotted.values())
        self.abbreviations = set()
        for w, d in dotted.items():
            if any(c.isalpha() for c in w):
                p, c = n_dotted / n, plain[w]
                score = -2 * (tlog(d, p) + tlog(c, 1 - p) - d * math.log(0.99) - c * math.log(0.01))
                inside = w.count(".")
                letters = len(w) - inside
                if score * math.exp(-letters) * (inside + 1) * letters**-c >= 0.3:
                    self.abbreviations.add(w)
        self.upper_mid, self.upper, self.lower, self.lower_start, begins, pairs, ends = set(), set(), set(), set(), Counter(), Counter(), 0
        for (w, _, up, low), before in rows:
            end = before[1] if before else "!"
            start = end == "!" or (end == "." and before[0] not in self.abbreviations)
            if up:
                self.upper.add(w)
                if end == "":
                    self.upper_mid.add(w)
            if low:
                self.lower.add(w)
                if start:
                    self.lower_start.add(w)
            if end == ".":
                if start and len(before[0]) > 1 and before[0] != S.NUMBER:
                    begins[w] += 1
                    ends += 1
                if len(before[0]) == 1 or before[0] == S.NUMBER:
                    pairs[before[0], w] += 1
        seen = dotted + plain
        self.starters = {
            w for w, b in begins.items()
            if any(c.isalpha() for c in w) and n > ends and b * n > seen[w] * ends and pair_score(ends, seen[w], b, n) >= 30
        }
        self.collocations = {
            (a, b) for (a, b), k in pairs.items()
            if k > 1 and b not in self.starters and a in seen and k <= min(seen[a], seen[b]) and n * k > seen[a] * seen[b]
            and pair_score(seen[a], seen[b], k, n) >= 7.88
        }

    def parts(self, a, b):
        w, (nxt, _, up, low) = a[0], b
        if (w, nxt) in self.collocations:
            return False
        opens = up and nxt in self.lower and nxt not in self.upper_mid
        goes_on = low and (nxt in self.upper or nxt not in self.lower_start)
        initial, short = len(w) == 1 and w.isalpha(), w in self.abbreviations
        if short and not initial:
            return opens or (up and nxt in self.starters)
        if initial or w == S.NUMBER:
            return not ((not opens and goes_on) or (initial and not opens and up and nxt not in self.lower) or short)
        return True

    def split(self, text):
        pieces = re.split(r"""(?<=\x01)""", re.sub(r"""([.!?]+["')\]]*\s+)""", "\\1\x01", text))
        pieces = [p.replace("\x01", "") for p in pieces]
        found = [""]
        for i, piece in enumerate(pieces):
            found[-1] += piece
            if i + 1 == len(pieces):
                break
            a, after = token(piece.split()[-1]), pieces[i + 1].split()
            if not (a[1] == "." and after) or self.parts(a, token(after[0])):
                found.append("")
        return [s.strip(" \t\n\v\f\r") for s in found if s.strip(" \t\n\v\f\r")]


def corpus():
    draw = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("mo", "ta", "ri", "ne") for b in ("la", "su", "ke") for c in ("n", "st", "ra")]
    texts = []
    for _ in range(500):
        out = []
        for _ in range(draw.randrange(1, 6)):
            own = [draw.choice(words) for _ in range(draw.randrange(3, 12))]
            own[0] = draw.choice(["The", "Then", own[0].capitalize(), own[0].capitalize()])
            if draw.random() < 0.4:
                own.insert(draw.randrange(1, len(own)), draw.choice(["Dr.", "approx.", "e.g.", "No.", "J."]) + " " + draw.choice(["Zorvik", "Molan", "nekera", "5.", "12"]))
            if draw.random() < 0.2:
                own.insert(1, draw.choice(["3.", "7."]) + " " + draw.choice(["Mai", "Mai", "talan"]))
            out.append(" ".join(own) + draw.choice([".", ".", ".", "!", "?", '."', " ...", "..."]))
        texts.append(draw.choice([" ", "  ", "\n"]).join(out))
    return texts


@pytest.fixture(scope="module")
def learnt(spark):
    texts = corpus()
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    return texts, rows, S.learn_splitter(rows), Brute(texts)


def test_model_equals_brute_force(learnt):
    _, _, model, brute = learnt
    rows = model.types.collect()
    assert {r["type"] for r in rows if r["abbreviation"]} == brute.abbreviations
    assert {"dr", "approx", "e.g"} <= brute.abbreviations and "zorvik" not in brute.abbreviations
    assert {r["type"] for r in rows if r["starter"]} == brute.starters and {"the", "then"} <= brute.starters
    for flag, want in (("upper_mid", brute.upper_mid), ("upper_seen", brute.upper), ("lower_seen", brute.lower), ("lower_start", brute.lower_start)):
        assert {r["type"] for r in rows if r[flag]} == want
    assert {tuple(r) for r in model.collocations.collect()} == brute.collocations and brute.collocations


def test_sentences_equal_brute_force(learnt):
    texts, rows, model, brute = learnt
    found = {}
    for r in S.split_learnt(rows, model, ["id"], "text").orderBy("id", "sentence_idx").collect():
        found.setdefault(r["id"], []).append(r["text"])
    assert found == {i: own for i, t in enumerate(texts) if (own := brute.split(t))}
    assert any("Dr. Zorvik" in s for own in found.values() for s in own)


def test_edges(spark, learnt):
    _, _, model, brute = learnt
    odd = [None, "", "  \n", "one", "Dr. Molan", "Dr.", "a. b", "x.\u0001Then y", "...", "5. Mai", "Ends. ", "(See e.g. this.) \"The end.\" the"]
    rows = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(odd)] + [(None, "No id. The end.")], "id long, text string")
    rows = rows.withColumn("other", F.lit(1))
    found = S.split_learnt(rows, model, ["id"], "text")
    assert found.columns == ["id", "other", "sentence_idx", "text"]
    by_id = {}
    for r in found.orderBy("id", "sentence_idx").collect():
        by_id.setdefault(r["id"], []).append(r["text"])
    want = {i: brute.split(t.replace("\u0001", " ")) for i, t in enumerate(odd) if t} | {None: brute.split("No id. The end.")}
    assert by_id == {i: own for i, own in want.items() if own}


def test_no_texts(spark):
    model = S.learn_splitter(spark.createDataFrame([], "text string"))
    assert model.types.count() == model.collocations.count() == 0
    rows = spark.createDataFrame([(1, "Dr. Molan. Then")], "id long, text string")
    assert [r["text"] for r in S.split_learnt(rows, model, ["id"], "text").collect()] == ["Dr.", "Molan.", "Then"]


def test_only_periods_that_may_hold_are_stored(monkeypatch, learnt):
    _, rows, model, brute = learnt
    stored, write_once = {}, S.write_once
    monkeypatch.setattr(S, "write_once", lambda df, name: stored.setdefault(name, write_once(df, name)))
    S.split_learnt(rows, model, ["id"], "text")
    found = [r["type"] for r in stored["borders"].collect()]
    holding = brute.abbreviations | {a for a, _ in brute.collocations} | {S.NUMBER}
    assert found and all(w in holding or len(w) == 1 for w in found)


def test_sentences_without_broadcasts(monkeypatch, learnt):
    texts, rows, model, brute = learnt
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(S, "lookup_join", partial(S.lookup_join, broadcast_bytes=-1, rows_per_salt=50))
    found = {}
    for r in S.split_learnt(rows, model, ["id"], "text").orderBy("id", "sentence_idx").collect():
        found.setdefault(r["id"], []).append(r["text"])
    assert found == {i: own for i, t in enumerate(texts) if (own := brute.split(t))}


def test_words_are_counted_before_they_are_taken_apart(spark):
    odd = ["\t(The \"end.\") Dr.\n[x] -5.5, No?! 'a..' !? ...\u000bA.B. (\"q\") \"'. end", "  ", "One", "Ö. ß 1. Ⅷ ", None, "a.  a.  a. a"]
    counts = S.count_words(spark.createDataFrame([(t,) for t in odd * 3], "text string"))
    want = Counter()
    for text in odd:
        own = [token(w) for w in re.split(r"[ \t\n\v\f\r]+", text or "") if w]
        for i, (w, end, up, low) in enumerate(own):
            if any(c.isalnum() for c in w):
                before = own[i - 1] if i else (None, "!")
                want[w, end, up, low and not up, before[1], before[0] if before[1] == "." else None] += 3
    assert {tuple(r[:6]): r["n"] for r in counts.collect()} == want
    # no expression is interpreted per word, and the tasks that read the texts only count
    plan = counts._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = plan[max(i for i, line in enumerate(plan) if "Aggregate" in line) + 1:]
    assert not any("lambdafunction" in line for line in plan) and not any("regexp_replace" in line for line in below)
