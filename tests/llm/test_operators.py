"""Each operator against brute force or a fixture, with the cases that a real table brings along."""

import math
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA, same_rows

from vecframe.llm import conversations, copies, leakage, neighbors, packing, pairs, queries, refusals, sentences, topn

SQL = queries.oracle_sql()


@pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, str(DATA / "sf0.001"))
    if name in SQL:
        same_rows(df, duck("sf0.001"), SQL[name])
    else:
        assert df.count() > 0


# copies

LISTS = [
    "task: load; primary: a-1; note: in batches", 'note : "in batches" ;task : "LOAD" ;primary : "a-1";', "TASK=load|note=in batches|primary=A-1", '{"primary": "a-1", "note": "in batches",\n "task": "load"}',
    "primary:  a-1\nnote:  in batches\ntask:  load\n", "task = 'load', note = 'in batches', primary = 'a-1'.",
]


def test_canonical():
    assert len({copies.canonical(x) for x in LISTS}) == 1
    assert copies.canonical("task: a; primary: b") != copies.canonical("task: b; primary: a")
    assert copies.canonical(" “Ünter　LAST — now?” ") == copies.canonical("ünter last, now") != copies.canonical("unter last now")
    assert copies.canonical("STRASSE") == copies.canonical("Straße") and copies.canonical("?! ") == ""
    assert copies.canonical("Before: what does a do?") == "beforewhatdoesado"
    assert copies.canonical('{"a": "x; y: z", "b": "q"}') == copies.canonical('b = "q", a = "x; y: z"')


def test_copies(spark):
    rng = random.Random(1)
    texts = ["Hello, world", "hello world!", "HELLO\tWORLD", "other", None, "", "?!", *LISTS, "task: b; primary: a", "task: a; primary: b", "été", "été", "x" * 50_000, "X" * 50_000]
    rows = [(i, rng.choice(texts), "z") for i in range(400)] + [(1000 + i, "Hot, hot!" if i % 2 else "hot HOT", "z") for i in range(400)]
    rows += [r for r in rows if rng.random() < 0.1]
    df = spark.createDataFrame(rows, "entry_id long, prompt string, key string").repartition(7)
    by: dict = {}
    for i, t, _ in rows:
        if t is not None and copies.canonical(t):
            by.setdefault(copies.canonical(t), set()).add(i)
    assert {tuple(r) for r in copies.p1_members(df).collect()} == {(min(v), x) for v in by.values() for x in v if x != min(v)}
    got = copies.p1_records(df).collect()
    assert {(r["first_id"], r["n_copies"]) for r in got} == {(min(v), len(v)) for v in by.values()}
    said = {i: t for i, t, _ in rows}
    assert all(r["prompt"] == said[r["first_id"]] for r in got)
    empty = df.limit(0)
    assert copies.p1_members(empty).count() == 0 and copies.p1_records(empty).count() == 0


# neighbours

def brute(ids, x, k=10):
    wide = x.astype(float)
    sims = np.round(wide @ wide.T / np.sqrt(np.outer((wide**2).sum(1), (wide**2).sum(1))), 6)
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sims[i, j], ids[j]))[:k]}


def found(df, k=10, **options):
    out = neighbors.nearest_neighbors(df, "adv_id", "embedding", 16, k, **options)
    return {(r[0], r[1]) for r in out.select("id", F.explode("near.id")).collect()}


def test_neighbors_exact_in_one_leaf(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 16)).astype(np.float32)
    x[20:30] = x[5]
    x[30] = 7 * x[5]
    ids = rng.permutation(1000)[:150]
    bad = [(2001, None), (2002, []), (2003, [1.0] * 15), (2004, [0.0] * 16), (2005, [float("nan")] * 16), (2006, [float("inf")] + [1.0] * 15), (2007, [None] * 16), (None, [1.0] * 16)]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows + rows[:20] + bad, "adv_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    assert found(df) == brute(ids, x)
    assert found(df.limit(0)) == set() and found(df.where(f"adv_id = {ids[0]}")) == set()


def test_neighbors_of_many_copies(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 200, axis=0), rng.normal(size=(60, 16))]).astype(np.float32)
    ids = rng.permutation(5000)[:260]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "adv_id long, embedding array<float>").repartition(5)
    assert found(df) == brute(ids, x)


def test_neighbors_of_hot_directions(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 1, 16))
    scaled = a * 2.0 ** rng.integers(-9, 9, size=(500, 1)) * rng.uniform(1, 2, size=(500, 1))
    close = b / np.linalg.norm(b) + 2e-5 * rng.normal(size=(500, 16))
    x = np.concatenate([scaled, close, rng.normal(size=(500, 16))]).astype(np.float32)
    ids = rng.permutation(9000)[:1500]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "adv_id long, embedding array<float>").repartition(5)
    truth, hot = brute(ids, x), set(map(int, ids[:1000]))
    for options in ({"leaf_rows": 100}, {"leaf_rows": 100, "sample_rows": 64}):
        got = found(df, **options)
        assert {p for p in got if p[0] in hot} == {p for p in truth if p[0] in hot}
    index = neighbors._unit(x)
    count, first = neighbors._ties(index)
    assert (count[:1000] == 500).all() and first[:1000].sum() == 2


def test_neighbors_rerank_in_chunks(monkeypatch):
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(1, 16)), 300, axis=0).astype(np.float32) * rng.uniform(1, 2, size=(300, 1)).astype(np.float32)
    monkeypatch.setattr(neighbors, "_PAIRS", 50)
    monkeypatch.setattr(neighbors, "_PRODUCTS", 1000)
    ids = rng.permutation(300)
    got = {(int(a), int(b)) for q, to, _ in neighbors._nearest(ids, x, neighbors._unit(x), np.ones(300, bool), 10) for a, b in zip(q, to)}
    assert got == brute(ids, x)


def test_neighbors_of_parallel_vectors_in_bounded_memory():
    rng = np.random.default_rng(8)
    x = (np.repeat(rng.normal(size=(1, 384)), 5000, axis=0) * rng.uniform(0.5, 2, size=(5000, 1))).astype(np.float32)
    x = np.concatenate([x, rng.normal(size=(100, 384)).astype(np.float32)])
    ids = rng.permutation(5100)
    tracemalloc.start()
    for leaf_rows in (100, 5000):  # by the clump, and by products in double precision
        table = pa.table({"leaf": np.zeros(5100, np.int64), "id": ids, "home": np.ones(5100, bool), "vec": pa.array([v.tobytes() for v in x])})
        out = neighbors._search(384, 10, leaf_rows, 4, 0.05, 5)(table).to_pydict()
        few = sorted(ids[:5000].tolist())
        for i, near in zip(out["id"], out["near"]):
            if i in set(few[:50]) or i == few[-1]:
                assert [y["id"] for y in near] == [j for j in few[:11] if j != i][:10]
        assert set(out["id"]) == set(range(5100))
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_neighbors_of_short_lists_are_completed(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "adv_id long, embedding array<float>").repartition(3)
    out = neighbors.nearest_neighbors(df, "adv_id", "embedding", 16, 10, trees=1, probes=1, leaf_rows=2)
    got, truth = {r["id"]: [y["id"] for y in r["near"]] for r in out.collect()}, brute(np.arange(400), x)
    assert len(got) == 400 and all(len(v) == 10 for v in got.values())
    assert {(i, j) for i, v in got.items() for j in v} == truth  # every leaf holds fewer than ten others


def test_neighbors_by_pure_random_projections(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(20, 16))[rng.integers(0, 20, 1500)] + 0.35 * rng.normal(size=(1500, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "adv_id long, embedding array<float>")
    truth = brute(np.arange(1500), x)
    assert len(found(df, leaf_rows=300, refine=0, trees=4, probes=8) & truth) >= 0.9 * len(truth)


def test_neighbors_recall_over_many_leaves(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16))
    x = (centers[rng.integers(0, 40, 3000)] + 0.35 * rng.normal(size=(3000, 16))).astype(np.float32)
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "adv_id long, embedding array<float>")
    truth = brute(ids, x)
    # the second splits its leaves once more in the task, the third by a second level of trees
    for options in ({"leaf_rows": 300}, {"leaf_rows": 300, "sample_rows": 64}, {"leaf_rows": 150, "sample_rows": 32, "group_rows": 400}):
        assert len(found(df, **options) & truth) >= 0.9 * len(truth)


def test_neighbors_move_once_for_leaves_of_one_region(spark):
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(12, 64))[rng.integers(0, 12, 4800)] + 0.8 * rng.normal(size=(4800, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "adv_id long, embedding array<float>")
    before = set(written(spark))
    near = neighbors.nearest_neighbors(df, "adv_id", "embedding", 64, leaf_rows=100).collect()
    assert len(near) == 4800 and all(len(r["near"]) == 10 for r in near)
    # every vector visits four leaves, or nearly so, and each visit alone would move it
    moved = max(n for stage, n in written(spark).items() if stage not in before)
    assert moved < 2 * x.nbytes


def written(spark):
    """The bytes that each stage wrote for its shuffle."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return {s.stageId(): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_parts_of_leaves():
    row = np.array([0, 0, 1, 1, 2, 2, 3, 3, 3, 4])
    leaf = np.array([0, 3, 0, 3, 1, 4, 1, 4, 0, 2])
    part = neighbors._parts(row, leaf, 6, 3)
    assert part[0] == part[3] and part[1] == part[4] and len(set(part.tolist())) == 4  # 2 and 5 stay alone
    assert set(neighbors._parts(row, leaf, 6, 0).tolist()) == set(range(6))
    assert len(set(neighbors._parts(row, leaf, 6, 9).tolist())) == 3


def test_best_of_the_leaves_of_a_part():
    near = lambda *hits: [{"far": f, "id": i} for f, i in hits]
    found = pa.table({"id": pa.array([7, 5, 7, 9]), "near": [near((-0.9, 2), (-0.5, 1)), near((-0.1, 7)), near((-0.9, 2), (-0.9, 1)), []]})
    assert neighbors._best(found, 2).to_pylist() == [{"id": 5, "near": near((-0.1, 7))}, {"id": 7, "near": near((-0.9, 1), (-0.9, 2))}, {"id": 9, "near": []}]


# top n

def test_top_n(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", " hot ", "b", "c ", None, " "]), rng.choice([0.5, 0.25, -1e-7, 0.0, float("nan"), None, float("inf"), rng.random()]), "x") for i in range(2000)]
    rows += rows[:300] + [(9000, "lone", 0.1, "x"), (None, "b", 0.0, "x")]
    df = spark.createDataFrame(rows, "match_id long, route_name string, distance double, bound string").repartition(6)
    by: dict = {}
    for i, name, d, _ in set(rows):
        if name and name.strip() and d is not None and not math.isnan(d) and i is not None:
            by.setdefault(name.strip(), set()).add((d, i))
    truth = {(k, i) for k, v in by.items() for _, i in sorted(v)[:5]}
    assert {(r["g"], r["id"]) for r in topn.p3_topn(df).collect()} == truth
    monkeypatch.setattr(topn, "_BOUND_BYTES", 1 << 40)  # bounds that no broadcast holds meet the rows in a shuffle
    assert {(r["g"], r["id"]) for r in topn.p3_topn(df).collect()} == truth
    assert topn.p3_topn(df.limit(0)).count() == 0


def test_top_n_of_many_groups_in_one_partition(spark):
    df = spark.range(0, 1_000_000, 1, 1).selectExpr("concat('g', id % 499999) as g", "cast(hash(id) % 1000 as double) as s", "id")
    began = time.perf_counter()
    assert topn.top_n(df, F.col("g"), F.col("s"), "id", 2).count() == 999_998
    assert time.perf_counter() - began < 30


def test_top_n_local_best():
    rng = random.Random(5)
    rows = sorted((f"g{rng.randrange(30)}", float(rng.randrange(4)), rng.randrange(20)) for _ in range(600))
    for size in (1, 2, 7, 600):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("g", "score", "id"), r)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in topn._local_best(3)(iter(batches)) for r in b.to_pylist()]
        truth = []
        for g in sorted({r[0] for r in rows}):
            best = sorted({r for r in rows if r[0] == g})[:3]
            truth += [(*r, r[1] if i == 2 else None) for i, r in enumerate(best)]
        assert got == truth


# conversations

def test_conversations(spark):
    rng = random.Random(7)
    rows, truth, mid = [], set(), 0

    def session(name, roles, kept, break_at=None, spell=lambda r: r):
        nonlocal mid
        out = []
        for i, r in enumerate(roles):
            mid += 1
            t = 1_700_000_000_000 + (i // 2) * 1000
            sent = str(t)
            content = " ​" if i == break_at else "text"
            out.append((mid, rng.choice([name, f" {name}", f"{name} "]), spell(r), content, sent, i % 2, "x"))
            if kept:
                truth.add((name, i + 1, mid))
        rows.extend(out)

    session("a", ["user", "assistant"] * 3, True, spell=lambda r: rng.choice({"user": [" User", "HUMAN"], "assistant": ["bot", "AI ", "Assistant"]}[r]))
    session("b", ["system", "system", "user", "assistant"], True)
    session("long", ["user", "assistant"] * 2000, True)
    session("c", ["user"], False)
    session("d", ["user", "user", "assistant"], False)
    session("e", ["system"], False)
    session("f", ["user", "system", "assistant"], False)
    session("g", ["assistant", "user"], False)
    session("h", ["user", "assistant", "user", "assistant"], False, break_at=2)
    session("i", ["user", "narrator"], False)
    session("badlong", ["user", "assistant"] * 500 + ["user"], False)
    rows += [(90_001, "j", "user", "x", "yesterday", None, "x"), (90_002, "j", "bot", "x", "1700000000001", None, "x"), (90_003, None, "user", "x", "1", 1, "x"), (90_004, " ", "user", "x", "1", 1, "x")]
    rows += [(90_005, "k", "user", "x", "2026-03-03T22:32:23.715+02:00", None, "x"), (90_006, "k", "bot", "x", "1772569943716", None, "x")]
    truth |= {("k", 1, 90_005), ("k", 2, 90_006)}
    rows += rows[::50]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "message_id long, session_id string, speaker_role string, content string, sent_ms string, seq_no long, turn string").repartition(5)
    got = {(r["session"], r["turn"], r["id"]) for r in conversations.p4_conversations(df).collect()}
    assert got == truth
    assert conversations.p4_conversations(df.limit(0)).count() == 0


def test_conversations_cut_at_calibrated_gaps(spark):
    rng = random.Random(8)
    rows, truth, mid = [], set(), 0
    for channel in ("c1", "c2", "c3", "hot"):
        t = 1_700_000_000_000
        for _ in range(300 if channel == "hot" else 30):
            t += rng.randrange(6, 30) * 3_600_000
            start, turns = t * 1000, rng.choice([1, 2, 2, 4, 6])
            for turn in range(turns):
                mid += 1
                rows.append((mid, channel, "ann" if turn % 2 == 0 else "bo", "text", str(t), None))
                if turns > 1:
                    truth.add((f"{channel}#{start}", turn + 1, mid))
                t += rng.randrange(5, 120) * 1000
    rows.append((mid + 1, "c1", "ann", "text", "unreadable", None))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "message_id long, channel string, speaker string, content string, sent_ms string, seq_no long").repartition(5)
    c = F.col
    # every channel begins with ann, so she is the user and the others answer; sessions of one message lack a reply
    known = conversations.inferred_roles(df, c("channel"), c("speaker"), conversations.instant(c("sent_ms")), "message_id")
    for gap in (None, 3_600_000_000):
        got = conversations.conversations(known, c("channel"), c("inferred_role"), c("content"), c("sent_ms"), c("seq_no"), "message_id", named=False, gap=gap)
        assert {(r["session"], r["turn"], r["id"]) for r in got.collect()} == truth
    assert conversations.conversations(known.limit(0), c("channel"), c("inferred_role"), c("content"), c("sent_ms"), c("seq_no"), "message_id", named=False).count() == 0


def test_calibrated_gap():
    assert conversations.calibrated_gap({}) is None and conversations.calibrated_gap({40: 1000, 41: 900, 42: 800}) is None
    gap = conversations.calibrated_gap({44: 50, 46: 400, 48: 300, 52: 3, 66: 40, 68: 90, 70: 30})
    assert 2 ** (48 / 2) < gap < 2 ** (66 / 2)


# pairs

TRAINED = {
    "en": ["The loader reads every key of the index and writes the answers to the store. Open the file, add the entry and restart the service when you are done."] * 3,
    "de": ["Der Import liest jeden Schlüssel des Index und schreibt die Antworten in den Speicher. Öffne die Datei, ergänze den Eintrag und starte den Dienst neu."] * 3,
    "zh": ["加载程序读取索引的每个键，然后把答案写入存储。请打开文件，添加条目，然后重新启动服务。"] * 3,
}


def test_defects():
    known = pairs.Languages(TRAINED)
    d = lambda p, r, s=None: pairs.defect(p, r, s, known)
    q = "How do I add the entry to the file of the index?"
    for r in (None, "", " \n", "<p> </p>", "N/A", "null", "…", "​", "**"):
        assert d(q, r) == "empty"
    for r in (q, q.upper(), f"You asked: {q}", f"Sure! {q}", f"{q} {q}", q[:-1] + "."):
        assert d(q, r) == "echo"
    for r in ("I'm sorry, but I can't help with that.", "My guidelines do not permit me to talk about it.", "Dabei kann ich leider nicht helfen.", "抱歉，我无法帮助您处理这个请求。", "Je préfère ne pas répondre."):
        assert d(q, r) == "refusal"
    assert d(q, "Öffne die Datei, ergänze den Eintrag und starte den Dienst neu.") == "language"
    assert d(q + " Answer in German.", "Öffne die Datei, ergänze den Eintrag und starte den Dienst neu.") is None
    for r in ("Open the file, add the entry and restart the ser", "Open the file,", 'Open it.\n```json\n{"a": [1,', "Open the file. There are three steps: first, you"):
        assert d(q, r) == "truncated"
    for r in ("Yes.", "25", "- a\n- b", "```\nSHOW x\n```", "Open the file and add the entry.", 'The error "unable to comply" means that the file is missing.', f"> {q}\n\nOpen the file and add the entry."):
        assert d(q, r) is None
    assert d(q, "Open the file and add the entry.", 0.01) == "truncated" and d(None, "Open the file.") is None


def test_refusals_of_any_length():
    reason = "The topic touches on the private matters of people who have not agreed to it, and what is said about them could do harm that nobody is able to undo later. "
    for r in (
        "Thank you for your question about a.yaml. " + reason * 3 + "For this reason I can't help with that request. Please write to help@desk.example or see https://desk.example/a_b instead.",
        "I'm sorry, but I can't help with that. " + reason * 3,
        "Diese Anfrage muss ich ablehnen, ich kann dabei leider nicht helfen. " + "Das Thema betrifft Menschen, die dem nicht zugestimmt haben, und was man über sie sagt, könnte ihnen schaden. " * 4,
        "抱歉，我无法帮助您处理这个请求。" + "这个话题涉及没有表示同意的人的私事，随便谈论可能会伤害他们。" * 12,
    ):
        assert len(r) > 240 and pairs.is_refusal(r, "What of a.yaml?")
    answer = "Open routes.json, add the entry of the tenant and reload the service so that new documents pick it up. Older keys keep their value until they expire. "
    assert not pairs.is_refusal(answer * 2 + "I cannot provide any more details on the older keys.")
    assert not pairs.is_refusal(answer * 2 + 'The text "I can\'t help with that" comes from the old service.')


DECLINING = [
    "I'd rather not talk about this.", "As an AI language model, I don't have the ability to do this.", "Das kann ich nicht tun.", "Je ne suis pas en mesure de répondre à cela.", "Lo siento, no puedo hacerlo.",
    "申し訳ありませんが、それはできません。", "很抱歉，我不能这样做。", "Sorry, no.", "I am not at liberty to talk about that.", "I'm not willing to answer that question.", "We can't tell you anything about this.",
    "I will have to pass on that.", "Ich möchte darüber nicht reden.", "Ich kann dir das leider nicht sagen.", "Je ne veux pas parler de ce sujet.", "Je regrette, je ne peux rien dire.", "No quiero responder a esa pregunta.",
    "No estoy en condiciones de responder.", "我不愿意谈这个问题。", "对不起，这个我不能说。", "その話題についてはお話ししたくありません。", "すみませんが、お答えできません。",
]
SOUND = [
    "The cache cannot answer until it is warm.", "You cannot delete the key while the index loads.", "No, it is not possible to change the key.", "Der Cache kann das nicht speichern.", "Das Feld kann nicht leer sein.",
    "Le cache ne peut pas répondre à temps.", "No puedes usar ese campo.", "El cargador no puede leer el archivo.", "缓存不能存储空值。", "このフィールドは空にできません。", "I don't know of a limit for this field.", "We do not store the vector.",
    "Sorry about that, the field is called rating.", "No.", "Nein.", "いいえ。", "I can confirm that the threshold is 0.2.",
]


def test_refusals_by_the_model():
    assert not {*DECLINING, *SOUND} & {*refusals.DECLINES, *refusals.ANSWERS}  # none of them was fitted on
    model = refusals.Refusals()
    found = [x for x in DECLINING if pairs.is_refusal(x, "What is it?", model)]
    assert found == DECLINING
    assert [x for x in SOUND if pairs.is_refusal(x, "What is it?", model)] == []
    assert pairs.is_refusal("Thank you for asking. " + DECLINING[0], "What is it?", model) and not pairs.is_refusal("Set index_name first. Then run it. " + DECLINING[0], "What is it?", model)


def test_sample_of_languages(spark):
    docs = [(i, "ein langes Wort " * 20_000, "de") for i in range(5)] + [(10, "kurz", "DE-at"), (11, "short", "english"), (12, "mot", "fr_FR"), (13, None, "fr"), (14, "", "fr")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert pairs.fit_languages(df, "doc_id", "text", "lang").names == ["de", "fr"]
    assert pairs.fit_languages(df, "doc_id", "text", "lang", languages=1).names == ["de"]


def test_truncated_lists(spark):
    for t, share in (("1. Open the file\n2. Then set the", None), ("1. Open the file\n2. Then set the va", 0.01), ("- Open the file.\n- Add the entry.\n- Then se", None), ("1. Open the file\n2.", None)):
        assert pairs.is_truncated(t, share)
    for t, share in (("- title\n- rating", None), ("1. Open the file\n2. Add the entry", None), ("1. Open the file\n2. Add the entry", 0.5), ("- Open it.\n- Close it.", None)):
        assert not pairs.is_truncated(t, share)
    said = ["Open the file and add the entry.", "Then set the value and add the entry.", "Title and rating are fields of the file.", "- title\n- rating\n- genre", "- rating\n- genre\n- title"] * 30
    lists = {1000: "1. Open the file\n2. Then set the", 1001: "1. Open the file\n2. Then set the val", 1002: "1. Open the file\n2. Add the entry", 1003: "- genre\n- rat", 1004: "- title\n- genre"}
    rows = [*((i, "How?", t) for i, t in enumerate(said)), *((i, "How?", t) for i, t in lists.items())]
    df = spark.createDataFrame(rows, "id long, prompt string, response string")
    got = {tuple(r) for r in pairs.defective_pairs(df, "id", "prompt", "response", pairs.Languages(TRAINED)).collect()}
    assert got == {(1000, "truncated"), (1001, "truncated"), (1003, "truncated")}


def test_defective_pairs_table(spark):
    rows = [(i, "How is it?", "It is well known here.", "x") for i in range(60)] + [(100, "How is it?", "It is well", "x"), (101, None, None, "x"), (101, None, None, "x"), (None, "a", None, "x")]
    df = spark.createDataFrame(rows, "hit_id long, prompt string, response string, share string")
    docs = spark.createDataFrame([(1, TRAINED["en"][0], "EN"), (2, None, "de"), (3, "x", None)], "doc_id long, text string, lang string")
    assert {tuple(r) for r in pairs.p5_defects(df, docs).collect()} == {(100, "truncated"), (101, "empty")}
    assert pairs.p5_defects(df.limit(0), docs.limit(0)).count() == 0


# packing

def test_packing(spark):
    rng = random.Random(3)
    sizes = {i: rng.choice([0, 1, 100, 700, 1500, 2048, 2049, 10_000, rng.randrange(1, 2048)]) for i in range(900)}
    df = spark.createDataFrame([*[(i, n, "x") for i, n in sizes.items()], (5000, None, "x"), (None, 3, "x")], "id long, n long, container string")
    got = packing.pack(df, "id", F.col("n"), group_items=400).collect()
    load: dict = {}
    parts: dict = {}
    for r in got:
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
        parts.setdefault(r["id"], []).append((r["first_token"], r["tokens"]))
    assert max(load.values()) <= 2048 and set(parts) == set(sizes)
    for i, n in sizes.items():
        at = 0
        for first, tokens in sorted(parts[i]):
            assert first == at
            at += tokens
        assert at == n and len(parts[i]) == max(1, -(-n // 2048))
    least = max(sum(sizes.values()) / 2048, sum(r["tokens"] > 1024 for r in got))
    assert len(load) <= 11 / 9 * least + 3  # the bound of first-fit decreasing, and a container for each group
    assert packing.pack(df.limit(0), "id", F.col("n")).count() == 0


def test_first_fit_decreasing_equals_the_plain_loop():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        sizes, ids, rooms, plain = rng.integers(0, 101, n), rng.permutation(n), [], {}
        for i in np.lexsort((ids, -sizes)):
            b = next((j for j, r in enumerate(rooms) if r >= sizes[i]), len(rooms))
            if b == len(rooms):
                rooms.append(100)
            rooms[b] -= sizes[i]
            plain[int(i)] = b
        assert dict(enumerate(packing.first_fit_decreasing(sizes, ids, 100).tolist())) == plain


# leakage

def test_leakage(spark):
    p = "Because every shepherd in Maskfell misplaced hollow tollgates, the orchard had 838 sundials left and its stubborn vintner traded quilts until spring."
    z = "因为弯曲的点灯人擦亮了萝卜，所以采石场只剩下895个狭长的账本，直到霜降才有点灯人借走了弯曲的罗盘。"
    items = spark.createDataFrame([(1, "b", "en", p), (2, "b", None, z), (3, "b", "en", None), (4, "b", "en", "")], "item_id long, benchmark string, lang string, passage string")
    w = p.split()
    yes = [p.upper(), "intro " + " ".join(w[4:16]) + " end", "a­b. " + p.replace("shepherd", "shep​herd").replace("orchard", "**orchard**"), " ".join(x for i, x in enumerate(w) if i not in (3, 9, 15)), " ".join("indeed " + x if i % 6 == 0 else x for i, x in enumerate(w)), p.replace("e", "é")]
    no = [" ".join(w[4:15]), " ".join(x for i, x in enumerate(w) if i % 4), " ".join(f"{x} one two three" for x in w), " ".join(sorted(w)), "", None]
    docs = [(i, t, "x") for i, t in enumerate(yes)] + [(100 + i, t, "x") for i, t in enumerate(no)] + [(200, "前文。" + z[8:30] + "后文", "x"), (201, z[:19], "x"), (202, "filler " * 30_000 + p, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item string")
    assert {tuple(r) for r in leakage.p7_leaked(df, items).collect()} == {(i, 1) for i in range(len(yes))} | {(200, 2), (202, 1)}
    assert leakage.p7_leaked(df.limit(0), items).count() == 0 and leakage.p7_leaked(df, items.limit(0)).count() == 0


def test_leakage_in_order_equals_the_plain_scan():
    rng = random.Random(6)
    for _ in range(300):
        p = leakage.Passage(1, [rng.choice("abcdefghijklm") for _ in range(rng.randrange(5, 30))], False)
        tokens = [rng.choice([*p.words, "x", "y"]) if rng.random() < 0.5 else p.words[i % len(p.words)] for i in range(rng.randrange(0, 60))]
        n, known = len(p.words), set(p.words)
        least, long = -(-n * 8 // 10), int(n * leakage.STRETCH)
        plain = any(w in known and leakage._in_order(p.words, tokens[i : i + long]) >= least for i, w in enumerate(tokens))
        run = any(tokens[j : j + 12] == p.words[i : i + 12] for i in range(n - 11) for j in range(len(tokens) - 11))
        assert leakage.holds(p, tokens, "".join(tokens), {0, *np.cumsum([len(t) for t in tokens]).tolist()}) == (plain or run)


def test_leakage_of_passages_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    text = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20)) for _ in range(40)]
    items = spark.createDataFrame([(i, "b", "en", t) for i, t in enumerate(text)], "item_id long, benchmark string, lang string, passage string")
    docs = spark.createDataFrame([(i, " ".join(t.split()[3:18])) for i, t in enumerate(text)], "doc_id long, text string")
    monkeypatch.setattr(leakage, "PASSAGE_BYTES", 1500)
    assert {tuple(r) for r in leakage.p7_leaked(docs, items).collect()} == {(i, i) for i in range(40)}


def test_leakage_of_joined_and_broken_words(spark):
    p = "Because every shepherd in Maskfell misplaced hollow tollgates, the orchard had 838 sundials left and its stubborn vintner traded quilts until spring."
    items = spark.createDataFrame([(1, "b", "en", p)], "item_id long, benchmark string, lang string, passage string")
    w = p.split()
    run = w[4:16]
    yes = ["".join(w), "Intro: " + "".join(run) + " end.", " ".join(" ".join(x) for x in run), " ".join(x[:2] + "-\n" + x[2:] if len(x) > 3 else x for x in run), " ".join(f"{x[0]}**{x[1:]}**" for x in run)]
    no = ["".join(run[:11]), "".join(sorted(w)), "x" + " ".join(run), " ".join(run) + "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(yes + no)], "doc_id long, text string")
    assert {tuple(r) for r in leakage.p7_leaked(df, items).collect()} == {(i, 1) for i in range(len(yes))}
    for length in (5, 12, 13, 40):
        words = [random.Random(length + i).choice("abcdefg") * (1 + i % 4) for i in range(length)]
        grams = leakage.Passage(1, words, False).run_grams()
        assert all(any(g in "".join(words[i : i + 12]) for g in grams) for i in range(length - 11))


# sentences

CASES = [
    ["Dr. Smith and J. R. Doe paid 3.5 percent, i.e. less.", "He left at 5 p.m.", "Why?!", "Nobody knows."],
    ['She typed "Stop. Do not go." and left.', '"Is it on?" she asked.', 'He said: "It works."', "Well... it runs."],
    ["It ended.", "It began again at https://a.example/x?y=1 for all.", "(See Fig. 3 of a.yaml.)", "iOS clients read it."],
    ["Das gilt z. B. für den 3. Mai.", "„Läuft es?“, fragte Hr. Müller.", "Am 2. März war Ende."],
    ["M. Blanc a relu l'art. 2.", "« Attendez. Ne partez pas. » dit-elle.", "Quel désordre..."],
    ["¿Quién fue?", "¡No toques!", "La Dra. Paz llegó a las 5 p. m. del lunes."],
    ["谁修改了它？", "别动！！", "他说：“停下。不要走。”然后离开了。", "「好了吗？」她问。", "负责人写道：“没问题！”", "嗯……还可以用。"],
    ["なぜ遅いのですか？", "彼は「待って。だめ。」と言った。", "版3.1でしきい値が変わった。"],
    ["Порог вырос до 2,20, т. е. вдвое.", "См. рис. 1 и табл. 2.", "Кто это?"],
    ["क्या यह तैयार है?", "डॉ. वेलन ने सीमा बढ़ाई।", "उसने कहा, \"रुकिए। अभी नहीं।\" और चला गया।"],
    ["هل اكتمل؟", "رفع د. فلارد الحد إلى 4.87 أمس.", "قال: \"توقف. لا.\" ثم غادر."],
    ["Γιατί αργεί;", "Ποιος άλλαξε το a.yaml;", "Η κρυφή μνήμη, π.χ. αυτή, είναι εδώ."],
]


def units(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, start_pos int")
    out: dict = {}
    for r in sentences.p8_units(df).collect():
        out.setdefault(r["id"], []).append((r["start_pos"], r["end_pos"]))
    return {i: [texts[i][a:b] for a, b in sorted(v)] for i, v in out.items()}


def test_sentences(spark):
    tight = lambda c: any("぀" <= x <= "鿿" for x in c[0])
    texts = [("" if tight(c) else " ").join(c) for c in CASES]
    got = units(spark, texts)
    for i, c in enumerate(CASES):
        assert got[i] == c
    wrapped = units(spark, [t.replace(" ", "\n") for t in texts])
    assert all([x.replace("\n", " ") for x in wrapped[i]] == c for i, c in enumerate(CASES))


def test_sentences_keep_addresses_and_names_whole(spark):
    cases = [
        ["Open https://host.example/search?Query=1 first.", "Then see www.Host.example/Guide.Setup!Top or HTTPS://Host.Example/A.B?C=D for more.", "It is at https://host.example/Guide.Setup."],
        ["Write to Jane.Doe@Mail.Example.Org today.", "He did."],
        ["Use `planner.Search` or `Q.Text!Now` now.", "System.Text.Json reads it.", "Call planner.Search(x) or index.SearchAsync again.", "Open report.PDF now."],
        ["The `rating` is worse.", "The `sessionId` is in Berlin.", "The rest follows (see https://a.example/x).", "Then stop."],
        ["See https://a.example/" + "Part.Next/" * 400 + "End for it.", "Done."],
    ]
    texts = [" ".join(c) for c in cases]
    texts[3] = "".join(cases[3])
    got = units(spark, texts)
    assert [got[i] for i in range(len(cases))] == cases


def test_sentences_after_abbreviations_in_any_case(spark):
    cases = [["Approx. 3 items came.", "DR. Smith paid them.", "See FIG. 3 and SEC. 2 for it."], ["It uses Node.JS and ASP.NET here.", "Call list.Add(x) in System.Text.Json."], ["I met Al.", "He said no.", "Then he left."]]
    got = units(spark, [" ".join(c) for c in cases])
    assert [got[i] for i in range(len(cases))] == cases


def test_sentence_positions_over_blocks(spark):
    for n in (0, 1, 2, 3, 4, 9, 3000):
        df = spark.createDataFrame([([(7 * i) % 5 for i in range(n)],)], "x array<int>")
        for block in (2, 4, 1024):
            assert df.where("size(x) > 0").select(sentences._starts(F.col("x"), block)).collect() == ([] if not n else [([sum((7 * i) % 5 for i in range(j)) for j in range(n)],)])
    text = "One. Two! " * 30_000
    got = units(spark, [text])[0]
    assert len(got) == 60_000 and set(got) == {"One.", "Two!"}


def test_sentences_of_long_quotations(spark):
    said = "Stop now. Do not go! " * 150
    cases = [[f"She read “{said}” and left.", "Done."], [f'She read "{said.strip()}" and left.', "Done."], [f"Er las „{said.strip()}“ und ging.", "Ende."], ["彼は「" + "待って。だめ！" * 300 + "」と言った。", "終わり。"], ["“One.” he said.", "Two “three.", "Four.", "Five."]]
    texts = [("" if i == 3 else " ").join(c) for i, c in enumerate(cases)]
    got = units(spark, texts)
    assert [got[i] for i in range(len(cases))] == cases


def test_sentences_of_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "One. Two."), (1, "One. Two."), (None, "Three. Four."), (None, "Five.")], "doc_id long, text string").repartition(3)
    got = sorted((str(r["id"]), r["start_pos"], r["end_pos"]) for r in sentences.p8_units(df).collect())
    assert got == [("1", 0, 4), ("1", 0, 4), ("1", 5, 9), ("1", 5, 9), ("None", 0, 5), ("None", 0, 6), ("None", 7, 12)]
    assert sentences.p8_units(df.limit(0)).count() == 0


def test_sentence_blocks(spark):
    texts = ["2.1 A heading\n \nText one.Text two !  ", "10. Drop the index\n\nDone.", "ระบบทำงาน ทีมงานพบ 5 รายการ แล้วจบ ใหม่อีกครั้ง", "no end", "  \n\n ", "", None, "ab. C\x04d.", "word " * 40_000 + "end. Next."]
    got = units(spark, texts)
    assert got[0] == ["2.1 A heading", "Text one.", "Text two !"] and got[1] == ["10. Drop the index", "Done."]
    assert got[2] == ["ระบบทำงาน", "ทีมงานพบ 5 รายการ", "แล้วจบ", "ใหม่อีกครั้ง"]
    assert got[3] == ["no end"] and 4 not in got and 5 not in got and 6 not in got and "".join(got[7]).replace(" ", "") == texts[7].replace(" ", "")
    assert got[8][-1] == "Next." and len(got[8]) == 2
