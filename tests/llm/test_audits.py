"""The filter audit, the conversation repair and the language models against brute force."""

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

from nearlight.llm import filter_audit, language_id, turn_repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, bits string, n string, gram string"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names clash with those inside."""
    return spark.createDataFrame([(*r, None, "clash", "clash", "clash", "clash") for r in rows], DOCS).repartition(3)


# --- filter audit


def brute_audit(rows, labels):
    first, good, toxic = {}, Counter(), Counter()
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= x == 1
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and t in first and first[t] < i,
        }
        docs.append((s or "", {k for k, v in fails.items() if v}, good[i], toxic[i]))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)
                ]
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(5)
    words = ["a", "B", "cd", "é", "\U0001F600", "x#", "y|", "Z"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words[: rng.choice([4, 8, 308])]) for _ in range(rng.choice([0, 5, 199, 200, 240]))) for _ in range(40)]
    texts += [None, "", " \n\t\x0b\x0c\r", "a b " * 250, "A", "é" * 49 + "A", "é" * 50 + "A"]
    rows = [(i if i % 17 else None, rng.choice(texts), rng.choice([None, "", "s", "t", "t", "t"])) for i in range(300)]
    rows += rows[:20] + [(-5, texts[0], "new"), (1 << 60, texts[1], "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1), (99999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit("clash"))
    got = filter_audit.audit(frame(spark, [(i, t, None, s) for i, t, s in rows]), marks).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in got} == want
    assert filter_audit.audit(frame(spark, []), marks.limit(0)).count() == 0


# --- conversation repair


def brute_repair(rows):
    """All edits of a short conversation ``[(turn, role, text, fault)]``, cheapest and least first."""
    ok = re.compile(r"(s?(ua)+)?\Z")
    best = None
    n = len(rows)
    gaps = [[""] + ["u", "a", "ua", "au"] for _ in range(n + 1)]
    for way in itertools.product("DKR", repeat=n):
        if any(rows[i][3] in "bd" and e != "D" for i, e in enumerate(way)):
            continue
        price = sum({"D": 4, "K": 0, "R": 3}[e] + (3 if e != "D" and rows[i][3] == "t" else 0) for i, e in enumerate(way))
        if best and price > best[0]:
            continue
        for names in itertools.product("ua", repeat=way.count("R")):
            for ins in itertools.product(*gaps):
                cost = price + 3 * sum(map(len, ins))
                if best and cost > best[0]:
                    continue
                roles, out, edits, given = [], [], "", iter(names)
                for i in range(n + 1):
                    for c in ins[i]:
                        roles.append(c)
                        out.append({"u": "user:", "a": "assistant:"}[c])
                        edits += "I"
                    if i < n:
                        edits += way[i]
                        if way[i] == "K":
                            roles.append(rows[i][1][:1] if rows[i][1][:1] in ("s", "u", "a") else "x")
                            out.append(f"{rows[i][1]}:{rows[i][2]}")
                        elif way[i] == "R":
                            c = next(given)
                            roles.append(c)
                            out.append({"u": "user:", "a": "assistant:"}[c] + rows[i][2])
                if ok.match("".join(roles)) and (best is None or (cost, edits) < best[:2]):
                    best = (cost, edits, "\n".join(out))
    return best


def with_faults(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    out, seen = [], set()
    for turn, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "o" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out[conv] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def expected(rows, solve):
    rows = with_faults(rows)
    cost, edits, body = solve(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    roles = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "x" for r in rows]
    faults = Counter(r[3] for r in rows)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["b"], faults["d"], faults["t"],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, edits, hashlib.sha256(body.encode()).hexdigest(),
    )


def by_table(rows):
    """Row by row, for each state of the pattern the cheapest edits so far; holds for conversations of any length."""
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    name = {"u": "user", "a": "assistant"}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for g, (cost, edits, body) in list(out.items()):
                c = "a" if g == 2 else "u"
                new = (cost + 3, edits + "I", body + (f"{name[c]}:",))
                if moves[g][c] not in out or new[:2] < out[moves[g][c]][:2]:
                    out[moves[g][c]] = new
        return out

    states = {0: (0, "", ())}
    for _, role, text, fault in rows:
        new = {}
        for g, (cost, edits, body) in inserted(states).items():
            ways = [(g, 4, "D", ())]
            if fault not in "bd":
                more = 3 * (fault == "t")
                if role[:1] in moves[g]:
                    ways.append((moves[g][role[:1]], more, "K", (f"{role}:{text}",)))
                c = "a" if g == 2 else "u"
                ways.append((moves[g][c], 3 + more, "R", (f"{name[c]}:{text}",)))
            for to, price, e, line in ways:
                way = (cost + price, edits + e, body + line)
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        states = new
    states = inserted(states)
    cost, edits, body = min(states[g] for g in (0, 3) if g in states)
    return cost, edits, "\n".join(body)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?  \n", "", " ", " ", "ok!", "a. b", None, "same.", "same.", "é.\x0b"]
    rows = []
    for c in range(n):
        conv = None if c == 0 else c * (1 << 40) - 7
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ["user", "assistant"][t % 2]
            rows.append((conv, None if rng.random() < 0.1 else t * rng.choice([1, 1, 3]), rng.choice([role] * 8 + ["system", None, "", "tool", "superuser"]), rng.choice(texts)))
    return rows + rows[:3]


def repaired(spark, rows):
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash")).withColumn("seq", F.lit(1)).repartition(3)
    got = turn_repair.repair(turn_repair.damaged(t)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got}


def test_search_is_cheapest_and_least():
    rng = random.Random(2)
    for _ in range(150):
        rows = [(i, rng.choice(["system", "user", "assistant", "tool"]), f"t{i}", rng.choice("ooootbd")) for i in range(rng.randint(0, 4))]
        cost, edits, body = brute_repair(rows)
        assert by_table(rows) == (cost, edits, body)
        roles = "".join(r[1][0] if r[1][0] in "sua" else "x" for r in rows)
        found = turn_repair.search(roles, "".join(r[3] for r in rows))
        ((_, got),) = found.items()
        assert got == (cost, edits)
        assert "\n".join(turn_repair.replay(edits, 0, [r[1] for r in rows], [r[2] for r in rows])) == body


def test_repair(spark):
    rows = conversations(4, 40, 9)
    assert repaired(spark, rows) == {c: expected(x, by_table) for c, x in damage(rows).items()}


@pytest.mark.parametrize("rows_each", [1, 2, 5])
def test_repair_in_segments(spark, monkeypatch, rows_each):
    """Long conversations: segments are searched alone and joined up (the stream's own size, as workers read the module)."""
    parts = []
    rows = conversations(9, 12, 60)
    convs = damage(rows)
    monkeypatch.setattr(turn_repair, "ROWS", rows_each)
    import pandas as pd

    for conv, own in convs.items():
        own = with_faults(own)
        held, s = [], turn_repair._Segment()
        for k, (turn, role, text, fault) in enumerate(own):
            if s.full():
                held.append(s)
                s = turn_repair._Segment()
            s.add(role[0] if role[:1] in ("s", "u", "a") else "x", fault, role, text, turn)
        held.append(s)
        segments = [turn_repair._part(conv, x, 0, q) for q, x in enumerate(held)]
        ways = turn_repair._choose(pd.DataFrame([{"at": x["at"], "seq": x["seq"], "costs": np.array(x["costs"]), "ranks": np.array(x["ranks"])} for x in segments]))
        names, kinds = turn_repair._types(turn_repair._PART.replace("at int", "conv_id long, illegal long, at int") + ", start int, end int")
        batch = turn_repair._batch([x | {"start": a, "end": b} for x, a, b in zip(segments, ways["start"], ways["end"])], names, kinds)
        parts += [(conv, r) for b in turn_repair._join_up(turn_repair._finish([batch])) for r in b.to_pylist()]
    got = {c: tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for c, r in parts}
    assert got == {c: expected(x, by_table) for c, x in convs.items()}


def test_repair_of_a_very_long_conversation(spark):
    rows = [(7, t, ["user", "assistant"][t % 2], ["Yes. " * (t % 3), "No", f"Well {t}."][t % 3]) for t in range(3000)] + [(8, 0, "user", "x" * 3_000_000 + ".")] * 40
    assert repaired(spark, rows) == {c: expected(x, by_table) for c, x in damage(rows).items()}


def test_repair_of_nothing(spark):
    assert repaired(spark, [(1, 1, "user", "a.")])[1][0] == 0
    dropped = next(t for t in range(100) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    assert repaired(spark, [(3, dropped, "user", "a.")]) == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair(turn_repair.damaged(empty)).count() == 0


# --- language models


def brute_models(texts):
    """Kneser-Ney by dictionaries: a function (lang, four symbols) -> probability, and the alphabet."""
    out = {}
    for lang, own in texts.items():
        c = Counter()
        for t in own:
            s = [0, 0, 0, *language_id.symbols(t)[0].tolist()]
            c.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
        levels = [c]
        for _ in range(3):
            levels.append(Counter(g[1:] for g in levels[-1]))
        levels = levels[::-1]
        model = []
        for c in levels:
            n = Counter(c.values())
            d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            total, kinds = Counter(), Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            model.append((c, d, total, kinds))
        out[lang] = (model, len(levels[0]))

    def p(lang, gram):
        model, v = out[lang]
        q = 1 / (v + 1)
        for k in range(1, 5):
            c, d, total, kinds = model[k - 1]
            g = tuple(gram[-k:])
            if total[g[:-1]]:
                q = max(c[g] - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * q
        return q

    return p, {lang: [g[0] for g in m[0][0]] for lang, (m, _) in out.items()}


LANGS = {"en": "the and of to in is that for with was on are this", "fr": "le la de et les des en un du que est pour dans élève où", "de": "der die und in den von zu das mit sich über größe", "日": "日本語 東京 大阪 \U00020000\U00020001 学校"}


def texts_of(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        text = "".join(rng.choice(LANGS[lang].split()) + rng.choice([" ", " ", ". ", "\n\n", " 42 "]) for _ in range(rng.randint(3, 60)))
        rows.append((i, text.upper() if i % 9 == 0 else text, lang, "s"))
    return rows


def test_kneser_ney(spark):
    texts = defaultdict(list)
    for _, t, lang, _ in texts_of(60):
        texts[lang].append(t)
    df = spark.createDataFrame([(lang, t) for lang, own in texts.items() for t in own], "lang string, text string").repartition(3)
    from nearlight.llm.common import scratch

    with scratch(spark):
        models = language_id.train(df)
    p, alphabet = brute_models(texts)
    assert [m.lang for m in models] == sorted(LANGS)
    rng = random.Random(3)
    for m in models:
        chars = alphabet[m.lang]
        for _ in range(40):
            ctx = [rng.choice([0, *chars, 9999]) for _ in range(3)]
            grams = np.array([sum(c << 16 * (3 - i) for i, c in enumerate([*ctx, w])) for w in [*chars, 9998]], np.uint64)
            got = m.probabilities(grams)
            np.testing.assert_allclose(got, [p(m.lang, [*ctx, w]) for w in [*chars, 9998]], rtol=1e-9)
            assert math.isclose(got.sum(), 1, rel_tol=1e-9)  # one unknown symbol stands for all
    some = [t for own in texts.values() for t in own][:20] + ["", "x" * 10]
    h, n, _ = language_id.entropies(models, some)
    for i, t in enumerate(some):
        s = [0, 0, 0, *language_id.symbols(t)[0].tolist()]
        assert n[i] == len(s) - 3
        for j, m in enumerate(models):
            assert math.isclose(h[i, j] * max(n[i], 1), -sum(math.log(p(m.lang, s[k - 3 : k + 1])) for k in range(3, len(s))), rel_tol=1e-9, abs_tol=1e-9)


def test_pieces_of_long_texts(monkeypatch):
    text = texts_of(1, 8)[0][1] * 50
    whole = language_id.codes([language_id.symbols(text)[0]])
    got = [g for held in language_id.batches_of(["ab", text, None, "", "c"], 7) for i, g, _ in held if i == 1]
    assert len(got) > 10 and (np.concatenate(got) == whole).all()


def test_floor_keeps_models_small_and_whole(spark, monkeypatch):
    from nearlight.llm.common import scratch

    df = spark.createDataFrame([(lang, t) for _, t, lang, _ in texts_of(200)], "lang string, text string")
    monkeypatch.setattr(language_id, "GRAMS", 80)
    with scratch(spark):
        models = language_id.train(df)
    for k in range(4):
        assert 0 < sum(len(m.grams[k]) for m in models) <= 80
    for m in models:
        for ctx in (0, 0x61 << 32 | 0x62 << 16 | 0x63):
            words = np.arange(1 << 16, dtype=np.uint64)
            assert m.probabilities(np.uint64(ctx << 16) | words).min() > 0


@pytest.mark.parametrize("grams", [1 << 19, 80, 4])
def test_no_gram_is_left_out(spark, monkeypatch, grams):
    """However few grams may travel, texts are judged by all."""
    from nearlight.llm.common import scratch

    monkeypatch.setattr(language_id, "GRAMS", grams)
    rows, texts = texts_of(120), defaultdict(list)
    for _, t, lang, _ in rows:
        texts[lang].append(t)
    p, _ = brute_models(texts)
    odd = [None, "", "12 #!", "a", "the xyzzy zzz", rows[0][1] * 3, "\U00020000"]
    docs = spark.createDataFrame([(None if i < 2 else i, t) for i, t in enumerate([t for _, t, _, _ in rows[:40]] + odd)], "k long, text string").repartition(3)
    with scratch(spark):
        all_ = language_id.counts(spark.createDataFrame([(lang, t) for _, t, lang, _ in rows], "lang string, text string"))
        langs, by = language_id.known_counts(all_)
        assert bool(language_id.large(by)) == (grams < 100)
        got = (language_id.spread(docs, all_, langs, by) if language_id.large(by) else language_id.judged(docs, language_id.models_of(all_, langs, by))).collect()
        other = language_id.judged(docs, language_id.train(spark.createDataFrame([(lang, t) for _, t, lang, _ in rows], "lang string, text string"))).collect()
    want = Counter()
    for i, t in enumerate([t for _, t, _, _ in rows[:40]] + odd):
        s, has = language_id.symbols(t or "")
        s = [0, 0, 0, *s.tolist()]
        h = sorted((-sum(math.log(p(lang, s[k - 3 : k + 1])) for k in range(3, len(s))) / max(1, len(s) - 3), lang) for lang in sorted(texts))
        want[(None if i < 2 else i, h[0][1], f"{h[0][0]:.8f}", f"{(h[1][0] - h[0][0]) * (len(s) - 3):.6f}") if has else (None if i < 2 else i, None, "", "")] += 1
    told = lambda x: Counter((r["k"], r["lang_pred"], "" if r["entropy"] is None else f"{r['entropy']:.8f}", "" if r["margin"] is None else f"{r['margin']:.6f}") for r in x)
    assert told(got) == want
    assert (told(other) == want) == (grams > 100)  # what travelled alone had left grams out


def test_identify_beyond_what_travels(spark, monkeypatch):
    docs = frame(spark, [*texts_of(150), (1000, None, "en", None), (1001, "12", None, None), (None, "the of and", None, None)])
    whole = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    monkeypatch.setattr(language_id, "GRAMS", 60)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert got.keys() == whole.keys() and all(got[i]["lang_pred"] == whole[i]["lang_pred"] and abs(got[i]["score"] - whole[i]["score"]) < 0.1 for i in got)


def test_identify(spark):
    rows = texts_of(400)
    odd = [(1000, None, "en", None), (1001, "", "en", None), (1002, "12 #! 3", None, None), (None, rows[0][1], rows[0][2], None), (1003, rows[1][1], None, None), (1004, "\U00020000", "日", None), (1005, "the of " * 700_000, None, None)]
    docs = frame(spark, rows + odd + rows[:3])
    got = language_id.identify(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows + odd + rows[:3])
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["doc_id"] in lang and r["held_out"]]
    assert len(held) > 50 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98
    by = {r["doc_id"]: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["accepted"]) == ("und", 0.0, False)
    assert by[None]["lang_pred"] == rows[0][2] and not by[None]["held_out"]
    assert by[1003]["lang_pred"] == rows[1][2] and by[1004]["lang_pred"] == "日" and by[1005]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)


def test_held_out_labels_are_never_read(spark):
    rows = texts_of(150)
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, "other") for i, t, lang, _ in rows]
    a, b = (sorted(map(tuple, language_id.identify(frame(spark, x)).collect())) for x in (rows, other))
    assert a == b


def test_identify_without_languages(spark):
    got = language_id.identify(frame(spark, [(1, "some text", None, None), (2, None, "en", None)])).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in got} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert language_id.identify(frame(spark, [])).count() == 0
