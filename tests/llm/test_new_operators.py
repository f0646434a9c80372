"""Chat formatting, importance resampling and conversation repair against plain versions, with awkward rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import chat_format, repair, resample
from tallyspark.llm.queries import oracle_sql, queries

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TALK = "conv_id long, turn long, role string, text string, nth long, piece string, start long, gone boolean, digest string, reverse string, audit string"
TEMPLATE = chat_format.Template()
ODD = [
    "", " ", "plain", "[INST]", " [/INST]", "[/INST] ", "<s>", "</s>", "<\\s>", "<\\\\s>", "[\\INST]", "<<SYS>>", "<\\<SYS>>", "\n<</SYS>>\n", "[ROLE]x[TEXT]y[/ROLE]", "<<s>>", "[[INST]]", "\\", "[\\", "<", "</s",
    "é \U0001F600 </s>", "a\nb\r\n\tc",
]
ROLES = ["user", "assistant", "system", "tool", "", "us[TEXT]er", "[/ROLE]", "User", "assistant "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, True, "d", "r", "a") for r in rows], TALK)


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_resample", "op13_conversation_repair"])
@pytest.mark.parametrize("size", ["sf0.1"])
def test_query_matches_sql(spark, name, size):
    d = f"/root/testdata/{size}"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, d).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


# --- chat formatting


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(ROLES), st.lists(st.sampled_from(ODD), max_size=6).map("".join))
def test_every_turn_comes_back(role, text):
    piece, turn, rounds = chat_format.render(TEMPLATE, role, text)
    assert (turn.role, turn.text) == (role, text)
    assert rounds == 1 or any(TEMPLATE.lookalike.search(x) for x in (role, text))
    # nothing that marks a turn is left inside of it
    assert not any(m.group() in TEMPLATE.markers for m in TEMPLATE.lookalike.finditer(piece[turn.start : turn.end]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.lists(st.sampled_from(ODD), max_size=4).map("".join)), max_size=6))
def test_conversations_parse_as_their_turns(turns):
    whole = "".join(chat_format.render(TEMPLATE, *t)[0] for t in turns)
    assert [(t.role, t.text) for t in chat_format.parse(TEMPLATE, whole)] == turns


def test_only_conflicting_texts_change():
    assert chat_format.render(TEMPLATE, "user", "a <b> [c] \\ d")[0] == "[INST] a <b> [c] \\ d [/INST]"
    piece, turn, rounds = chat_format.render(TEMPLATE, "assistant", "x</s>[INST] y [/INST]")
    assert piece == "<s>x<\\/s>[\\INST] y [\\/INST]</s>" and rounds == 4
    with pytest.raises(chat_format.NotInGrammar):
        chat_format.parse(TEMPLATE, "[INST] open")
    with pytest.raises(chat_format.NotInGrammar):
        chat_format.parse(TEMPLATE, "[INST] a <s> b [/INST]")


def test_another_template():
    t = chat_format.Template((("user", "<|user|>", "<|end|>\n"), ("assistant", "<|bot|>", "<|end|>\n")), ("<|role|>", "<|says|>", "<|end|>\n"))
    for role, text in itertools.product(("user", "assistant", "tool", "<|end|>"), ("<|end|>", "<|user|>\n", "<\\|bot|>", "<|", "|>")):
        assert (lambda x: (x.role, x.text))(chat_format.render(t, role, text)[1]) == (role, text)
    with pytest.raises(ValueError):
        chat_format.Template((("user", "[", "]"),))


def plain_format(rows):
    """conv_id -> digests, from the turns alone."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        chars = sum(len(chat_format.render(TEMPLATE, *t)[0]) for t in turns)
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), chars)
    return out


def test_format_awkward_rows(spark):
    rows = [(c, t, random.Random(c * 31 + t).choice(ROLES), random.Random(c + t * 7).choice(ODD)) for c in range(5) for t in range(6)]
    rows += [(7, 0, None, None), (7, None, "user", "first"), (7, 1, "assistant", "same"), (7, 1, "assistant", "same"), (None, 0, "assistant", "no id"), (8, 0, "assistant", "long </s> " * 50_000)]
    df = talk(spark, rows)
    got = {r["conv_id"]: tuple(r[1:6]) for r in chat_format.report(df).collect()}
    assert got == plain_format(rows)
    out = chat_format.pieces(df)
    assert {r["conv_id"]: tuple(r[1:6]) for r in chat_format.read_back(out).collect()} == got
    for r in chat_format.joined(out).collect():
        assert len(r["text"]) == got[r["conv_id"]][4]
        learned = "".join(r["text"][s["start"] : s["end"]] for s in r["spans"])
        turns = chat_format.parse(TEMPLATE, r["text"])
        assert learned == "".join(r["text"][t.start : t.end] for t in turns if t.role == "assistant")
        assert sha("".join(f"{t.role}\n{t.text}\n" for t in turns)) == got[r["conv_id"]][1]
    assert chat_format.report(talk(spark, [])).count() == 0


# --- importance resampling


def plain_resample(docs, target, percent=10, seed=2024, least=20, max_n=1, buckets=10_000):
    """A row for each document: (doc_id, n_features, weight, score, rank)."""

    def runs(text):
        w = WORD.findall((text or "").translate(str.maketrans(UP, LOW)))
        return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)], len(w)

    ours = Counter(crc32(f.encode()) % buckets for _, t in docs for f in runs(t)[0])
    theirs = Counter(crc32(f.encode()) % buckets for t in target for f in runs(t)[0])
    s, t = sum(ours.values()), sum(theirs.values())
    gain = [math.floor(1000 * math.log((theirs[b] + 1) * (s + buckets) / ((ours[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        found, n = runs(text)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: math.floor(percent * len(able) / 100)]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resample_awkward_rows(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["the", "The", "né", "Über", "x" * 90, "y" * 3000, f"w{rnd.randrange(40)}", f"r{rnd.randrange(10**6)}"])
    docs = [(i, " ".join(word() for _ in range(rnd.choice([0, 3, 25, 60])))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "... !!"), (None, "no id " * 20), (203, "copy of one text " * 10), (203, "copy of one text " * 10), (204, " ".join(f"v{i % 5000}" for i in range(60_000)))]
    target = ["the w1 w2 w3", None, "", "Über né the the", "z" * 200]
    given = spark.createDataFrame([(*d, 1, 2, "a", "b", 3) for d in docs], "doc_id long, text string, row long, weight long, feature string, rest string, rank int")
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    for settings_ in ({}, {"max_n": 3, "percent": 35, "least_words": 5, "buckets": 97, "seed": 7}):
        rows = resample.resample(given, wanted, **settings_).select("doc_id", "n_features", "weight", "score", "rank").collect()
        plain = {k: v for k, v in zip(("percent", "seed", "least", "max_n", "buckets"), (settings_.get(x) for x in ("percent", "seed", "least_words", "max_n", "buckets"))) if v is not None}
        assert sorted(map(tuple, rows), key=repr) == plain_resample(docs, target, **plain)
    picked = resample.drawn(given, wanted).collect()
    assert {r["doc_id"] for r in picked} == {r[0] for r in plain_resample(docs, target) if r[4]}


def test_resample_without_hot_features(spark, monkeypatch):
    """Everything through the join of the dictionary, nothing by the strings that travel along, and the other way round."""
    docs = [(i, f"a b c d{i % 7} e{i} " * 6) for i in range(60)]
    given, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a d1 d2 zz",)], "text string")
    for hot, size in ((1, 80), (50_000, 0), (50_000, 80)):
        monkeypatch.setattr(resample, "HOT", hot)
        monkeypatch.setattr(resample, "HOT_BYTES", size)
        got = resample.resample(given, wanted).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, got), key=repr) == plain_resample(docs, ["a d1 d2 zz"])


def test_resample_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    got = resample.resample(some, none).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got)) == plain_resample([(1, "a b " * 20)], [])


# --- conversation repair


def cheapest(rows):
    """(cost, audit, repaired) of (initial, role, text, must_go, truncated) by trying every sequence of edits with at most two inserts in a row."""
    best = None

    def go(i, out, audit, cost, inserted):
        nonlocal best
        initials = "".join(r[:1] or "?" for r, _ in out)
        if not re.fullmatch("s?(ua)*u?", initials) or best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if inserted < 2:
            for r in ("user", "assistant"):
                go(i, [*out, (r, "")], audit + "I", cost + 5, inserted + 1)
        if i < len(rows):
            role, text, must, cut = rows[i]
            go(i + 1, out, audit + "D", cost + 2, 0)
            if not must:
                go(i + 1, [*out, (role, text)], audit + "K", cost + 5 * cut, 0)
                for r in ("user", "assistant"):
                    go(i + 1, [*out, (r, text)], audit + "R", cost + 1 + 5 * cut, 0)

    go(0, [], "", 0, 0)
    return best


def test_trie_against_every_edit_sequence():
    texts = {"x": (True, False)}
    for length in range(6):
        ways = itertools.product("xsuaoSUAO", repeat=length) if length < 4 else (random.Random(k).choices("xsuaoSUAO", k=length) for k in range(150))
        for letters in ways:
            path = [repair.END]
            for x in reversed(letters):
                path.append(repair.layer(x, path[-1]))
            role = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
            rows = [(role[x.lower()], f"t{n}", *texts.get(x, (False, x.isupper()))) for n, x in enumerate(letters)]
            cost, audit, out = cheapest(rows)
            assert (path[-1][0][repair.START], repair.audit_of(path, "".join(reversed(letters)))) == (cost, audit), letters
            state, got = repair.START, []
            walk = iter(rows)
            for e in audit:
                row, state = repair.edited(None if e == "I" else next(walk)[:2], e, state)
                got += [row] if row else []
            assert got == out


def test_trie_computes_a_shared_prefix_once(spark, monkeypatch):
    import pyarrow as pa

    reverse = sorted("".join(random.Random(k).choices("ua", k=random.Random(k).randrange(12))) for k in range(300))
    made = []
    monkeypatch.setattr(repair, "layer", lambda x, after, real=repair.layer: made.append(x) or real(x, after))
    batches = [pa.RecordBatch.from_arrays([pa.array(reverse[i : i + 70])], names=["reverse"]) for i in range(0, 300, 70)]
    list(repair.walk_trie(iter(batches)))
    assert len(made) == len({r[:n] for r in reverse for n in range(1, len(r) + 1)})


def plain_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        hurt = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            lot = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if lot == 1:
                text = ""
            elif lot == 2:
                text = re.sub("[.!?]", "", text)
            elif lot == 4:
                role = "user"
            hurt += [(turn, role, text)] * {0: 0, 3: 2}.get(lot, 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, sha(f"{len(r[1].encode())}:{r[1]}:{r[2]}")))
        turns = [t for t, *_ in hurt if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in hurt:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(hurt, hurt[1:]))
        cost, audit, lines = cheapest([(role, text, f in ("blank", "duplicate"), f == "truncated") for (_, role, text), f in zip(hurt, faults)])
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in lines)))
    return out


def awkward_talk():
    rnd = random.Random(11)
    texts = ["ok.", "cut off", "", " \t\n", "why?", "é!", ".", "a.b", None, "no end  ", "x.\n"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", None, "", "Sys", "sam"]) if rnd.random() < 0.3 else ("user", "assistant")[t % 2], rnd.choice(texts)) for c in range(60) for t in range(rnd.randrange(1, 6)) if rnd.random() < 0.9]
    return rows + [(100, None, "user", "a."), (100, None, "assistant", "b."), (101, 5, "user", "same."), (101, 5, "user", "same."), (101, 9, "assistant", "z."), (None, 0, "user", "q?"), (None, None, "assistant", "r.")]


def test_repair_awkward_rows(spark):
    rows = awkward_talk()
    df = talk(spark, rows)
    want = plain_repair(rows)
    assert {r[0]: tuple(r)[1:] for r in repair.report(df).collect()} == want
    hurt = repair.damaged(df)
    text = {}
    for r in repair.repaired(hurt, repair.planned(hurt)).orderBy("conv_id", "nth").collect():
        assert r["nth"] == len(text.setdefault(r["conv_id"], []))
        text[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: sha("\n".join(text.get(c, []))) for c in want} == {c: v[-1] for c, v in want.items()}
    assert repair.report(talk(spark, [])).count() == 0


def test_repair_of_a_conversation_with_a_third_of_all_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3_000)] + [(2 + c, t, ("user", "assistant")[t % 2], "hello.") for c in range(1_500) for t in range(4)]
    got = {r["conv_id"]: r for r in repair.report(talk(spark, rows)).collect()}
    assert len(got) == 1_501 and len(got[1]["audit"]) >= 2_800
    # damage takes one row of twenty, so the audit says what became of each row that is left
    left = [t for t in range(3_000) for _ in range({0: 0, 3: 2}.get(crc32(f"1:{t}".encode()) % 20, 1))]
    assert sum(x != "I" for x in got[1]["audit"]) == len(left)
