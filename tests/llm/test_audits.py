"""Line dedup, turn repair and source divergence against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextquarry.llm import divergence, firsts, line_dedup, turn_repair

SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, key string, k1 long, a long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# line dedup


def brute_lines(rows, least=10):
    def who(r):
        return (r[0] is None, r[0], 0) if r[0] is not None else (True, 0, r[1] or "")

    keys = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            key = line.strip(SPACE).translate(UPPER)
            if len(key) >= least:
                keys[key].add(who(r))
    out = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        # which of several rows without id comes first goes by a hash of the text, so fixtures share no line among such rows alone
        kept = [x for x in lines if not keys.get(x.strip(SPACE).translate(UPPER)) or min(keys[x.strip(SPACE).translate(UPPER)]) == who(r)]
        out[(r[0], len(lines), len(lines) - len(kept), sha("\n".join(kept)))] += 1
    return out


def line_rows():
    common = "A Line That Many Share"
    texts = [
        f"{common}\nonly here number one\nshort\n\nshort", f"  {common.lower()}\t\r\n{common.upper()}\nsomething else here", "short\nshort", None, "", "\n\n", "ÄÖÜ äöü 12", "äöü äöü 12\nÄÖÜ äöü 12 ",
        "\U0001f600" * 10 + "\n" + "é" * 9, "é" * 9 + "\nx" + "\n" + "\U0001f600" * 10, "x" * 3_000_000 + "\n" + common, "\n".join(f"line number {i}" for i in range(5000)), "line number 77\nown line of text", common + "\n" + common,
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, f"{common}\nno id has this line"), (3, "another text of id three\nonly here number one"), (1, texts[1]), (1, texts[1]), (1, "something else here"), (-5, "line number 9")]
    return [(*r, None, "s", "k", 7, 8) for r in rows]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_line_dedup(spark, partitions):
    rows = line_rows()
    got = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS).repartition(3), partitions=partitions).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == brute_lines(rows)
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    for r in got:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8))
        assert int(bits.sum()) == r.n_lines - r.n_dropped
        assert r.kept_sha256 in {sha(line_dedup.kept_lines(t, r.keep)) for t in texts[r.doc_id] if (t or "").count("\n") + 1 == r.n_lines}


def test_line_dedup_of_nothing_and_of_rows_without_id(spark, empty):
    assert not line_dedup.line_dedup(empty).collect()
    rows = [(None, f"the same line of text\n{i}") for i in range(50)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r.n_dropped for r in got) == [0] + [1] * 49


def test_line_dedup_of_a_line_in_every_document(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line of all documents\nown line "), F.col("id").cast("string")).alias("text"))
    got = line_dedup.line_dedup(docs, partitions=16)
    assert [r.doc_id for r in got.where("n_dropped = 0").collect()] == [0]
    assert got.where("n_dropped = 1").count() == 2999


def test_no_task_sorts_texts_of_lines(spark, empty):
    """Texts stream past the lists of dropped lines; a sort would hold a task's texts."""
    plan = line_dedup.line_dedup(empty)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_later_rows_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    for n, kinds, partitions in ((400, 1, 7), (400, 3, 9), (300, 60, 4), (1, 1, 3), (0, 1, 3)):
        rows = [(int(k), 1, int(a), int(b), i) for i, (k, a, b) in enumerate(zip(rng.integers(0, kinds, n), rng.integers(0, 9, n), rng.integers(0, 3, n), strict=True))]
        least = {}
        for r in rows:
            least[r[0]] = min(least.get(r[0], r[2:4]), r[2:4])
        got = firsts.later_rows(spark.createDataFrame(rows, "k1 long, k2 long, a long, b long, i long").repartition(5), partitions).collect()
        assert sorted(r.i for r in got) == [r[4] for r in rows if r[2:4] != least[r[0]]]


# turn repair


def brute_damage(rows):
    """conv_id -> rows (turn, role, text) after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        order = (turn is not None, turn or 0, role.encode(), hashlib.md5(text.encode()).digest())
        if kind == 0:
            continue
        role, text = "user" if kind == 4 else role, "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        out[conv] += [(order, turn, role, text)] * (2 if kind == 3 else 1)
    return {c: [r[1:] for r in sorted(v, key=lambda r: r[0])] for c, v in out.items()}


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute_edits(turns):
    """(cost, audit, repaired) by trying every sequence of edits."""
    found = faults(turns)
    best = None

    def initials(said):
        return "".join(r[:1] or " " for r, _ in said)

    def go(i, cost, audit, said):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if not re.fullmatch(r"s?(ua)*u?", initials(said)):
            return
        if i == len(turns):
            if re.fullmatch(r"(s?(ua)+)?", initials(said)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, said)
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                go(i, cost + 3, audit + "I", [*said, (role, "")])
        if i == len(turns):
            return
        _, role, text = turns[i]
        go(i + 1, cost + 4, audit + "D", said)
        if found[i] not in ("blank", "duplicate"):
            more = 3 * (found[i] == "truncated")
            if role:
                go(i + 1, cost + more, audit + "K", [*said, (role, text)])
            for new in ("user", "assistant"):
                go(i + 1, cost + 3 + more, audit + "R", [*said, (new, text)])

    go(0, 0, "", [])
    return best


def conversation_rows():
    rng = np.random.default_rng(2)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "umpire"], ["Yes.", "No", "  ", "", None, "Why?\n", "So it is! ", "ends. not"]
    rows = []
    for conv in range(160):
        n = int(rng.integers(1, 6))
        usual = conv % 2
        for t in range(n):
            role = ("user", "assistant")[t % 2] if usual else roles[rng.integers(0, 7)]
            rows.append((conv, int(rng.integers(0, 4)) if conv % 5 == 0 else t, role, f"Turn {t} says more." if usual and rng.random() < 0.7 else texts[rng.integers(0, 8)]))
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Ho."), (None, None, "system", "So."), (500, None, "user", "x"), (501, 9_000_000_000, "user", "far."), (501, 0, "assistant", "near.")]
    rows += rows[:3]
    return [(*r, 1, "x", 2) for r in rows]


TURNS = "conv_id long, turn long, role string, text string, block long, initial string, _at long"


def test_turn_repair(spark):
    rows = conversation_rows()
    after = brute_damage(rows)
    frame = spark.createDataFrame(rows, TURNS).repartition(3)
    got = {r.conv_id: r for r in turn_repair.repair(frame).collect()}
    assert set(got) == {r[0] for r in rows}
    repaired = {}
    for conv, r in got.items():
        turns = after.get(conv, [])
        cost, audit, said = brute_edits(turns)
        repaired[conv] = said
        found, whens, first = Counter(faults(turns)), [t for t, _, _ in turns if t is not None], [role[:1] or " " for _, role, _ in turns]
        assert (r.cost, r.audit) == (cost, audit), (conv, turns)
        assert r.repaired_sha256 == sha("\n".join(f"{role}:{text}" for role, text in said))
        assert (r.blank, r.duplicate, r.truncated) == (found["blank"], found["duplicate"], found["truncated"])
        assert r.gaps == (max(whens) - min(whens) + 1 - len(set(whens)) if whens else 0)
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    turns = turn_repair.damage(frame)
    out = defaultdict(list)
    for r in turn_repair.repaired_turns(turns, turn_repair.audits(turns)).orderBy("conv_id", "turn").collect():
        assert r.turn == len(out[r.conv_id])
        out[r.conv_id].append((r.role, r.text))
    assert {c: v for c, v in repaired.items() if v} == dict(out)


def test_turn_repair_of_nothing(spark):
    assert not turn_repair.repair(spark.createDataFrame([], TURNS)).collect()
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    r = turn_repair.repair(spark.createDataFrame([(1, dropped, "user", "gone.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(x) for x in r] == [(1, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_a_long_conversation_is_repaired_in_segments(spark, monkeypatch):
    """The same audits from segments of any length, for a conversation that is most of the table."""
    rng = np.random.default_rng(4)
    roles = ["user", "assistant", "assistant", "user", "system", "tool"]
    rows = [(7, t, roles[rng.integers(0, 6)], ("Fine.", f"Word {t}.", f"cut {t}", "")[rng.integers(0, 4)]) for t in range(700)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Say {c} {t}.") for c in range(100, 140) for t in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    turns = brute_damage(rows)[7]
    found, best = faults(turns), {0: (0, "")}
    for (_, role, _), fault in zip(turns, found, strict=True):  # without segments
        new = {}
        for (state, (cost, audit)), move in product(best.items(), turn_repair._moves()):
            frm, to, letters, price, stays, need = move
            if frm == state and (not stays or (fault not in ("blank", "duplicate") and need in (None, role[:1]))):
                way = (cost + price + 3 * (stays and fault == "truncated"), audit + letters)
                new[to] = min(new.get(to, way), way)
        best = new
    want = min((c + {0: 0, 1: 6, 2: 3, 3: 0}[s], a + {0: "", 1: "II", 2: "I", 3: ""}[s]) for s, (c, a) in best.items())
    first = [role[:1] or " " for _, role, _ in turns]
    for bits, fan in ((7, 32), (3, 2)):
        monkeypatch.setattr(turn_repair, "SEGMENT_BITS", bits)
        monkeypatch.setattr(turn_repair, "FAN", fan)
        r = turn_repair.repair(frame).where("conv_id = 7").first()
        assert (r.cost, r.audit) == want
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))


# source divergence


def brute_divergence(rows, least, top):
    tokens = [((r[2] or ""), (r[3] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(UPPER))) for r in rows]
    df, n, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in tokens:
        df[lang].update(set(words))
        n[lang, source].update(words)
        total[lang].update(words)
    out = set()
    for lang in {t[0] for t in tokens}:
        kept = [t for t, c in df[lang].items() if c >= least]

        def shares(count, kept=kept):
            whole = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (whole + 5 * len(kept)) for t in kept}

        q, sources = shares(total[lang]), sorted({t[1] for t in tokens if t[0] == lang})
        p = {s: shares(n[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((q[t] - p[s][t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def divergence_rows():
    rng = np.random.default_rng(8)
    words = ["The", "tree", "ÉTÉ", "été", "x1y", "don't", "a_b", "日本", "\x7fz", "und", "über", "MiXed"]
    rows = []
    for i in range(240):
        source = (None, "", "a", "b", "ß", "Z", "c9", "lone")[rng.integers(0, 8)] if i % 3 else "hot"
        lang = ("en", "de", None, "", "few")[i % 5 if i % 40 else 4] if i % 7 else "en"
        text = " ".join(words[k] for k in rng.zipf(1.6, rng.integers(0, 40)) if k < len(words))
        rows.append((i, text if i % 11 else (None, "", " 12 34 ")[i % 3], lang, source))
    rows += [(None, "the tree", "en", "a"), rows[4], rows[4], (900, "tree " * 400_000 + "y" * 1_200_000, "en", "long"), (901, "x", "one", "only")]
    return [(*r, "k", 1, 2) for r in rows]


@pytest.mark.parametrize(("chunk", "block"), [(4096, 32), (3, 2)])
def test_divergence(spark, monkeypatch, chunk, block):
    rows = divergence_rows()
    monkeypatch.setattr(divergence, "SPAN", 2)
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    got = divergence.divergence(frame, least_docs=6, top=3, chunk=chunk, block=block).collect()
    want = brute_divergence(rows, 6, 3)
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_divergence_without_terms_or_rows(spark, empty):
    assert not divergence.divergence(empty).collect()
    rows = [(1, None, "en", "b"), (2, "", "en", "a"), (3, "12", "en", None), (4, "few words", "de", "a")]
    got = divergence.divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {tuple(r) for r in got} == brute_divergence([r + (None,) for r in rows], 30, 50)
    assert all(r.value == 0 and r.part == "pair" for r in got)
    assert len(got) == 6


def test_shares_are_exact(spark):
    cases = [(0, 5), (1, 10), (10**13, 10**13 + 5 * 10**6), (7_777_777_777_777, 8_999_999_999_999_999), (3, 10**15)]
    got = spark.createDataFrame(cases, "n long, total long").select(divergence.share(F.col("n"), F.col("total")).alias("p"), "n", "total").collect()
    for r in got:
        want = 1 + 10**9 * (r.n + 5) // r.total
        assert r.p == want
        assert divergence._shares(np.array([[r.n]]), np.array([[r.total]]))[0, 0] == want
