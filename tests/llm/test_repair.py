"""Conversation repair against exhaustive search and a plain pass."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tessaline.llm import repair
from tessaline.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        told = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def judged(rows):
    """Rows in order and the first fault of each."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, found = set(), []
    for _, _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        found.append("B" if not said else "D" if (role, text) in seen else "T" if said[-1] not in ".!?" else "-")
        seen.add((role, text))
    return rows, found


def exhaustive(initials, faults):
    """The least (cost, audit) and its roles, of all sequences of edits with up to two insertions at a place."""
    fills = ["", "u", "a", "ua", "au"]
    found = []
    for gaps in itertools.product(fills, repeat=len(initials) + 1):
        for edits in itertools.product("KDua", repeat=len(initials)):
            roles, audit, cost = gaps[0], "I" * len(gaps[0]), 5 * len(gaps[0])
            for initial, fault, edit, gap in zip(initials, faults, edits, gaps[1:]):
                if edit == "D":
                    audit, cost = audit + "D", cost + 2
                elif fault in "BD":
                    break
                else:
                    roles, audit = roles + (initial if edit == "K" else edit), audit + ("K" if edit == "K" else "R")
                    cost += (edit != "K") + 5 * (fault == "T")
                roles, audit, cost = roles + gap, audit + "I" * len(gap), cost + 5 * len(gap)
            else:
                if re.fullmatch("(s?(ua)+)?", roles):
                    found.append((cost, audit, roles))
    return min(found)


def plain(rows):
    """All columns of a conversation, by a plain pass over whole audits."""
    rows, found = judged(rows)
    initials = [r[2][:1] for r in rows]
    layer = {"": (0, "", "")}  # what the grammar has read, shortened to its state
    state = lambda roles: roles if roles in ("", "s") else roles[-1]

    def legal(roles):
        return re.fullmatch("(s?(ua)*u?)?", roles) is not None

    def closed(options):
        best = {}
        for cost, audit, roles in options:
            for more in ("", "u", "a", "ua", "au"):
                if legal(roles + more):
                    way = (cost + 5 * len(more), audit + "I" * len(more), roles + more)
                    if state(way[2]) not in best or way < best[state(way[2])]:
                        best[state(way[2])] = way
        return best

    layer = closed(layer.values())
    for initial, fault in zip(initials, found):
        ways = []
        for cost, audit, roles in layer.values():
            ways.append((cost + 2, audit + "D", roles))
            if fault not in "BD":
                more = 5 * (fault == "T")
                ways += [(cost + more, audit + "K", roles + (initial or "?"))] + [(cost + more + 1, audit + "R", roles + x) for x in "ua"]
        layer = closed([w for w in ways if legal(w[2])])
    cost, audit, roles = min(w for w in layer.values() if re.fullmatch("(s?(ua)+)?", w[2]))
    edits, lines, at, k = iter(audit), [], 0, 0
    for edit in edits:
        if edit != "D":
            role = rows[at][2] if edit == "K" else ROLES[roles[k]]
            lines.append(f"{role}:{'' if edit == 'I' else rows[at][3]}")
            k += 1
        at += edit != "I"
    turns = [r[1] for r in rows if r[1] is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": found.count("B"), "duplicate": found.count("D"), "truncated": found.count("T"),
        "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def test_pass_against_exhaustive_search():
    rng = random.Random(1)
    cases = [("".join(rng.choice("sua x"[:n]) for _ in range(k)), "".join(rng.choice("--BDT") for _ in range(k))) for k in (0, 1, 2, 3) for n in (3, 5) for _ in range(12)]
    for initials, faults in cases:
        cost, audit, roles = exhaustive(initials, faults)
        (found, state) = repair.best(repair.advance(repair.start(), initials, faults))
        assert found == (cost, audit) and state in repair.ENDS
        assert "".join(r[0] for r, _ in repair.edited(0, audit, list(initials), ["x"] * len(initials))) == roles


@pytest.fixture
def uncoalesced(spark):
    """Ranges stay as many as they are dealt in, however small."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "false")
    yield lambda n: spark.conf.set(names[1], n)
    for name, value in before.items():
        spark.conf.set(name, value)


def conversations(rng, n):
    texts = ["Yes.", "No!", "cut off", "  \n", "", "why?", "Is it? é.", "Long " * 20 + ".", "x.  ", "dot.\x0b", None]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice([0, 1, 3, 8, 40])):
            role = rng.choices(["user", "assistant", "system", "tool", "", None], [8, 8, 2, 1, 1, 1])[0]
            rows.append((conv, rng.choice([turn, turn, turn, 3 * turn, None]), role, rng.choice(texts[:-1] + [f"said {turn}."] * 8 + [None])))
    return rows + rows[:5]


@pytest.mark.parametrize(("segment", "parts"), [(1_024, 4), (1, 4), (3, 7)])
def test_repair_against_a_plain_pass(spark, monkeypatch, uncoalesced, segment, parts):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", segment)
    rows = conversations(random.Random(segment), 60)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", fault string")
    uncoalesced(parts)
    repaired = repair.repair(repair.damage(df.repartition(3)))
    got = {r["conv_id"]: r.asDict() for r in repair.digests(repaired).collect()}
    said = repaired.messages().orderBy("part", "run", "seg", "place").collect()
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        want = plain([r for r in damaged(rows) if r[0] == conv])
        assert {k: row[k] for k in want} == want
        told = "\n".join(f"{m['role']}:{m['text']}" for m in said if m["conv_id"] == conv)
        assert hashlib.sha256(told.encode()).hexdigest() == want["repaired_sha256"]


def test_one_conversation_over_many_tasks(spark, monkeypatch, uncoalesced):
    """A conversation that holds nearly all rows is dealt by its turns."""
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 50)
    uncoalesced(4)
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["Same.", f"n {t}.", f"cut {t}"])) for t in range(3_000)] + [(c, 0, "user", "Hi.") for c in range(100, 120)]
    df = spark.createDataFrame(rows, SCHEMA)
    repaired = repair.repair(df)
    assert repaired.parts.filter("conv_id = 7").select("part").distinct().count() > 1
    got = {r["conv_id"]: r.asDict() for r in repair.digests(repaired).collect()}
    for conv in (7, 101):
        want = plain([r for r in rows if r[0] == conv])
        assert {k: got[conv][k] for k in want} == want


def test_empty_and_absent_rows(spark):
    none = repair.digests(repair.repair(repair.damage(spark.createDataFrame([], SCHEMA))))
    assert none.collect() == []
    df = spark.createDataFrame([(1, 0, "user", "Gone.", False), (2, None, None, None, True), (2, 5, "user", "x" * 1_000_000 + ".", True)], SCHEMA + ", present boolean")
    got = {r["conv_id"]: r for r in repair.digests(repair.repair(df)).collect()}
    assert got[1]["audit"] == "" and got[1]["cost"] == got[1]["gaps"] == 0 and got[1]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[2]["blank"], got[2]["gaps"], got[2]["audit"], got[2]["cost"]) == (1, 0, "DD", 4)


def test_query_on_the_given_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r.asDict() for r in QUERIES["op13_conversation_repair"](spark, path).collect()}
    after = damaged(rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        want = plain([r for r in after if r[0] == conv])
        assert {k: got[conv][k] for k in want} == want
