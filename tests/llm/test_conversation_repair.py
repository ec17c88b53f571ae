import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from clinloom.llm import conversation_repair as cr
from clinloom.llm import queries

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def plain_audit(rows):
    """All of it for one conversation's rows, by the best (cost, letters) of every suffix."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {r[1] for r in rows} - {None}
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") or not a for a, b in zip(initials, initials[1:], strict=False))

    @lru_cache(maxsize=None)
    def best(i, state, run):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def go(letter, cost, j, to, made, again=0):
            rest = best(j, to, again)
            if rest:
                found.append((cost + rest[0], letter + rest[1], made + rest[2]))

        follow = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[follow]
        if run < 2:
            go("I", 2, i, follow, (f"{name}:",), run + 1)
        if i < len(rows):
            role, text = rows[i][2:]
            go("D", 3, i + 1, state, ())
            if faults[i] not in ("blank", "duplicate"):
                cut = int(faults[i] == "truncated")
                go("R", 2 + cut, i + 1, follow, (f"{name}:{text}",))
                if role[:1] == follow or role[:1] == "s" and state == "":
                    go("K", cut, i + 1, role[:1], (f"{role}:{text}",))
        return min(found, default=None)

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, made = best(0, "", 0)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(), made)


def plain(rows, broken):
    ids = {r[0] for r in rows}
    return {c: plain_audit([r for r in broken if r[0] == c])[:8] for c in ids}


def got(df):
    return {r["conv_id"]: (*[r[c] for c in cr.FACTS], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op11_conversation_repair"](spark, sf_dir)
    assert got(found) == plain(rows, plain_damage(rows))
    assert found.count() == len({r[0] for r in rows})


def test_codes_against_plain():
    deal = random.Random(7)
    for _ in range(400):
        rows = []
        for k in range(deal.randint(0, 7)):
            role = deal.choice(["system", "user", "assistant", "tool", " ", ""])
            rows.append((1, k, role, deal.choice(["", " \n", f"t{k}.", f"t{k}", "same!", "cut, "])))
        wanted = plain_audit(rows)
        segment = cr.Segment(1, bytearray())
        seen = set()
        for _, turn, role, text in rows:
            bare = text.rstrip(SPACE)
            kind = {"s": 1, "u": 2, "a": 3}.get(role[:1], 4)
            code = 0 if not bare else kind + 4 * (bare[-1] not in ".!?")
            segment.add(turn, role, role + text, code, not bare, (role, text) in seen)
            seen.add((role, text))
        assert (segment.turns, segment.blank, segment.duplicate, segment.truncated, segment.illegal) == (len(rows), *wanted[1:5])
        assert cr.solve(bytes(segment.codes)) == wanted[5:7]
        # Cut anywhere, segments chain to the same letters.
        codes = bytes(segment.codes)
        for cut in range(1, len(codes)):
            edges = [{"conv_id": 1, "seg": s, "matrix": sum(cr.transfer(c), []), "last": "", "first": "", "high": None, "low": None} for s, c in enumerate((codes[:cut], codes[cut:]))]
            borders = cr._borders(edges)
            state, letters = 0, ""
            for s, c in enumerate((codes[:cut], codes[cut:])):
                b = borders[1, s]
                ends = cr._tight(c, b)
                letters += cr._walked(c, b, state)[0]
                state = ends[state]
            assert (borders[1, 0].best, letters) == wanted[5:7]


def odd_rows():
    deal = random.Random(3)
    rows = [(None, None, None, None), (None, 3, "user", "Lone."), (5, None, "user", "a."), (5, None, "user", "a."), (5, 2, "assistant", "b " + "x" * 200_000), (5, 2, "assistant", "Tie."), (5, 9, "", "?"), (6, 0, "system", "Only."), (7, 0, "tool", "ünï 日本."), (8, 1, "user", "")]
    hot = []
    for k in range(600):
        hot.append((1, k if k % 50 else None, deal.choice(["user", "assistant", "system", "assistant"]), deal.choice(["Same words.", f"Turn {k}.", f"cut {k}", "  ", "Why?"])))
    return rows + hot + hot[:20]


@pytest.mark.parametrize("damage", [False, True])
def test_odd_and_split(spark, damage):
    """Nulls, ties, repeated rows, and a conversation that lies in many partitions."""
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(1).alias(c) for c in ("seg", "codes", "audit", "cost", "key")]).repartition(7)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    broken = plain_damage(rows) if damage else clean
    given = cr.damaged(df) if damage else df
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = cr.with_all(cr.audits(given), df)
        assert got(cr.digests(given, found)) == plain(rows, broken)
        made = {}
        for r in sorted(cr.repaired(given, found).collect(), key=lambda r: r["at"]):
            made.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        for conv in {r[0] for r in rows}:
            assert made.get(conv, []) == list(plain_audit([r for r in broken if r[0] == conv])[8])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.digests(df, cr.with_all(cr.audits(df), df)).count() == 0
    assert cr.repaired(df, cr.audits(df)).count() == 0
