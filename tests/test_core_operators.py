import json
import random
import re

import pytest
from pyspark.sql import functions as F

from recollect.operators import envelopes, evidence, layers, resolve
from recollect.sources import jsonl
from recollect.streaming import ingest

MESSAGES = "batch int, pos int, role string, content string, timestamp long"


def adapt(spark, *contents, role="user", ms=None):
    rows = spark.createDataFrame([(1, i, role, c, ms) for i, c in enumerate(contents)], MESSAGES)
    return [r.asDict() for r in envelopes.adapt_messages(rows, "batch", "pos").orderBy("pos", "step").collect()]


def test_dialogue(spark):
    got = adapt(spark, "[ledger_7b][session_4][D4:9][text] Ottilie Brandt: The ferry was late", ms=1700000000000)[0]
    assert (got["family"], got["role"], got["content"], got["timestamp"]) == ("dialogue", "Ottilie Brandt", "The ferry was late", 1700000000000)
    got = adapt(spark, "[quarry-set][session_2][D2:5][text] human: (2 of 3) The second half")[0]
    assert (got["role"], got["content"]) == ("user", "(2 of 3) The second half")


def test_tags_end_at_the_first_that_is_none(spark):
    rows = spark.createDataFrame([(0, "[orchard][session_3][apple] rest"), (1, "[x] y"), (2, None), (3, "[orchard]  [time: Unknown]\nbody")], "i int, content string")
    got = {r["i"]: (r["_tags"], r["_body"]) for r in envelopes.with_body(rows, "content").collect()}
    assert got == {0: (["orchard", "session_3"], "[apple] rest"), 1: ([], "[x] y"), 2: ([], ""), 3: (["orchard", "time: Unknown"], "body")}


def test_narration_and_document(spark):
    got = adapt(spark, "[harbour][session_9][D9:1][narration] NARRATION: (Rain over the pier.)")[0]
    assert (got["family"], got["role"], got["content"]) == ("narration", "narration", "(Rain over the pier.)")
    got = adapt(spark, "[harbour][session_9][D9:2][narration] NARRATION: PILOT: Two knots, no more.", "KEEPER: The lamp is out")
    assert [g["role"] for g in got] == ["PILOT", "KEEPER"]
    got = adapt(spark, "[north_map][session_1][text] document: Survey of wells\nsheet 2 of 8")[0]
    assert (got["family"], got["role"]) == ("document", "document") and got["content"].startswith("Survey of wells")


def test_triples(spark):
    body = json.dumps({"subject": "Lake Orta", "relation": "depth in metres", "object": "143", "subject_id": "Q7"})
    got = adapt(spark, "Corpus: " + body, "Corpus: UPDATE: measured anew\n" + body)
    assert got[0]["content"] == "Lake Orta | depth in metres | 143" and got[0]["role"] == "corpus"
    assert got[1]["content"].startswith("UPDATE: Lake Orta | depth in metres | 143")


def test_times_feedback_trajectory_plain(spark):
    got = adapt(spark, "[Time: Feb 29, 2024, 12:00:01] Good noon")[0]
    assert (got["family"], got["role"], got["timestamp"]) == ("plain", "user", 1709208001000)
    assert adapt(spark, "[Time: some day] KEEPER: Still here.")[0]["timestamp"] is None
    got = adapt(spark, 'Streaming online QA feedback:\n{"qa_id":"w-12","predicted_answer":"four"}')[0]
    assert got["family"] == "qa-feedback" and "not authoritative" in got["content"] and "\n" in got["content"]
    steps = [{"role": "system", "content": "rules"}, {"role": "user", "content": "open the crate"}]
    got = adapt(spark, "Streaming intra-transfer train trajectory:\n" + json.dumps({"dataset": "CRATES", "task_index": 5, "trajectory": steps}))
    assert [(g["role"], g["content"]) for g in got] == [("system", "[CRATES task index 5] rules"), ("user", "[CRATES task index 5] open the crate")]
    assert adapt(spark, "今日は雨")[0]["family"] == "plain"
    assert adapt(spark, "Listen: rain")[0]["role"] == "user" and adapt(spark, "#12: aye")[0]["role"] == "#12"


def test_evidence(spark):
    rows = [(1, "a", ["s"], 87.0), (2, " a ", ["s"], 5.0), (3, "", ["s"], 1.0), (4, "b", [], 1.0), (5, "c", ["s"], None), (6, "d", [" "], 1.0)]
    got = evidence.validate(spark.createDataFrame(rows, "pos int, content string, source array<string>, score double"), "pos").orderBy("pos").collect()
    assert [r["status"] for r in got] == ["valid", "rejected", "rejected", "rejected", "repaired", "rejected"]
    assert got[0]["score"] == 0.87 and got[4]["score"] == 0.5 and got[1]["reason"] == "duplicate"
    shown = evidence.response_rows(spark.createDataFrame(rows, "pos int, content string, source array<string>, score double"), "pos", 2).collect()
    assert len(shown) == 2 and shown[0]["id"].startswith("mem_")


def test_greedy_merge_keeps_first(spark):
    rows = [(1, 1, "Tamsin keeps a grey heron", ["a"]), (1, 2, "tamsin keeps a grey heron!", ["b"]), (1, 3, "Tamsin keeps one grey heron", ["c", "a"]), (1, 4, "Tamsin rows boats", ["d"]), (2, 1, "船员", ["e"])]
    got = resolve.greedy_merge(spark.createDataFrame(rows, "c int, p int, t string, s array<string>"), "c", "p", "t", "s").orderBy("c", "p").collect()
    assert [(r["p"], r["s"], r["n_merged"]) for r in got] == [(1, ["a", "b", "c"], 3), (4, ["d"], 1), (1, ["e"], 1)]


def test_near_duplicate_needs_new_source(spark):
    kind = "k int, t string, s array<string>"
    stored = spark.createDataFrame([(0, "Tamsin keeps a grey heron", ["a", "b"])], kind)
    new = spark.createDataFrame([(1, "Tamsin keeps one grey heron", ["a"]), (2, "Tamsin keeps one grey heron", ["z"]), (3, "Ruben slept", ["a"])], kind)
    assert sorted(r["k"] for r in resolve.not_yet_known(new, stored, "k", "t", "s").collect()) == [2, 3]


def test_lookback_keeps_session(spark):
    rows = spark.createDataFrame([(1, i, 1 + i % 2, f"m{i}") for i in range(12)], "c int, p int, s int, id string")
    got = layers.lookback(rows, "c", ["p"], "s", ["id"], 3).where("p = 11").first()["context"]
    assert [x["id"] for x in got] == ["m5", "m7", "m9"]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n[{"a": 2}, {"a": 3}]\n{"a": \n7\n')
    from pyspark.sql import types as T

    lines = jsonl.read_lines(spark, str(path))
    schema = T.StructType([T.StructField("a", T.LongType())])
    got = jsonl.parse(lines, schema)
    assert sorted(r["record"]["a"] for r in got.where("record is not null").collect()) == [1, 2, 3]
    assert jsonl.report(lines).first().asDict() == {"n_records": 2, "n_bad": 2, "n_blank": 1}
    folder = str(tmp_path / "v")
    assert jsonl.latest_version(spark, folder) is None
    jsonl.write_version(lines, folder, "1")
    assert jsonl.write_version(lines, folder, "2") == jsonl.latest_version(spark, folder)


def test_ingest_is_idempotent(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    request = lambda r: {"request_id": r, "user_id": "u", "session_id": "s", "messages": [{"role": "user", "content": "hi", "timestamp": 1}]}
    (tmp_path / "in").mkdir()
    for name, ids in (("1", ["a", "b", "a"]), ("2", ["b", "c"])):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(request(r)) for r in ids))
        ingest.append_messages(ingest.requests(spark, source), target, state).awaitTermination()
    assert sorted(r["request_id"] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_tumbling_counts(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in ingest.tumbling_counts(events, "t", "1 hour", "1 hour", "k").collect()) == [1, 2]


def test_packing_and_chunking(spark):
    from recollect.operators import memory

    assert memory.packed([5, 5, 5], 10, 16, 1) == [[0, 1], [1, 2]]
    assert memory.packed([5, 50, 5], 10, 16, 1) == [[0], [1], [2]]
    assert memory.packed([9] * 5, 10, 2, 0) == [[0], [1, 2, 3, 4]]
    text = "\n".join(f"line {i} of the text" for i in range(50)) + "\n" + "x" * 900 + "医" * 300
    chunks = memory.cut_message(text, 40, 10)
    assert all(memory.token_cost(c) <= 40 for c in chunks) and "".join(memory.cut_message(text, 40)) == text
    assert memory.cut_message("short", 40) == ["short"]
    rows = spark.createDataFrame([(1, i, "word " * 30) for i in range(9)], "s int, p int, t string")
    groups = memory.pack_sessions(rows, "s", "p", "t", 100).collect()
    assert {g["p"] for g in groups} == set(range(9)) and max(g["group"] for g in groups) > 1


def test_salvage():
    from recollect.operators import memory

    assert memory.salvaged('[{"a": {"b": 1}, "c": 2}, {"a": 3') == (['{"a": {"b": 1}, "c": 2}'], 1)
    assert memory.salvaged('[{"a": {"b": 1}, {"c": 2}]') == (['{"a": {"b": 1}}', '{"c": 2}'], 0)
    assert memory.salvaged("nothing") == ([], 0)


def test_salvage_and_repair():
    from recollect.sources import lenient

    assert lenient.repaired('{"a": [1, 2,], "b": {"c": "}{",}}') == '{"a": [1, 2], "b": {"c": "},{"}}'
    assert json.loads(lenient.balanced('[{"a": {"b": 1, "c": "]"}')) == [{"a": {"b": 1, "c": "]"}}]
    assert lenient.parsed_text('{"a": 1}\n\nx')[:4] == ("linewise", [{"a": 1}], 1, 1)
    assert lenient.parsed_text('[{"a":\n1}\n{"a":\n2}]')[:2] == ("document", [{"a": 1}, {"a": 2}])
    assert lenient.parsed_text('[{"a":\n1}, {"a":\n2}, {"b": "x')[0::4] == ("salvaged", 1)
    assert lenient.parsed_text("") == ("linewise", [], 0, 0, 0)
    assert lenient.tool_calls('{"tool": "bash", "command": "ls"} }') == [{"tool": "bash", "args": {"command": "ls"}}]
    assert lenient.tool_calls("") == [] and lenient.tool_calls('{"name": "x"}') == []


def test_model_calls_are_tried_again_only_if_it_may_help():
    from recollect.operators import model

    class Flaky:
        def __init__(self, *failures):
            self.left, self.calls = list(failures), 0

        def complete(self, messages):
            self.calls += 1
            if self.left:
                raise self.left.pop(0)
            return "fine"

    slept = []
    busy, refused = model.CallFailed("busy", 503), model.CallFailed("content policy", 400)
    assert model.called(Flaky(busy, busy), [], 3, slept.append) == ("fine", "", None) and slept == [2.0, 4.0]
    client = Flaky(refused)
    assert model.called(client, [], 3, slept.append) == ("", "content policy", 400) and client.calls == 1
    assert model.called(Flaky(*[busy] * 3), [], 3, slept.append)[1:] == ("busy", 503)


def test_failed_calls_leave_states(spark):
    from recollect.operators import model

    def failing_client():
        class Refusing:
            def complete(self, messages):
                raise model.CallFailed("maximum context reached", 400)

        return Refusing()

    rows = spark.createDataFrame([(1, "", "text")], "k int, context string, content string")
    assert [tuple(r) for r in model.extract_atoms(rows, "k", "context", "content", failing_client).select("state", "atom").collect()] == [("failed", None)]
    asked = spark.createDataFrame([(1, "q?", None, "2024-01-01")], "k int, q string, e array<struct<time:string,source:array<string>,content:string>>, d string")
    got = model.answer(asked, "q", "e", "d", failing_client).first()["answer"]
    assert (got["answer"], got["unsupported"], got["error"]) == (None, True, "maximum context reached")


def test_samples_are_read_or_an_error(spark, tmp_path):
    from recollect.operators import dataset

    (tmp_path / "s.json").write_text(json.dumps([{"qa": [1]}, {"qa": []}], indent=1))
    got = dataset.load_samples(spark, str(tmp_path / "s.json")).orderBy("sample_no").collect()
    assert [(r["sample_no"], json.loads(r["sample"])) for r in got] == [(0, {"qa": [1]}), (1, {"qa": []})]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        dataset.load_samples(spark, str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        dataset.parse_indices("1, x")


def test_fact_merges_match_brute_force(spark):
    """The two queries without SQL, against the predicate applied to every pair."""
    from recollect.plans import registry

    facts = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        facts[r["doc_id"]] = " ".join(re.split(r"\s+", r["text"] or "")[:8])
    same = lambda a, b: _same_fact(facts[a], facts[b])
    got = {r["doc_id"] for r in registry.QUERIES["near_dup_reject"](spark, "/root/testdata/sf0.001").collect()}
    odd, even = [i for i in facts if i % 2], [i for i in facts if i % 2 == 0]
    assert got == {a for a in odd if not any(a % 3 == b % 3 and same(a, b) for b in even)}
    want = {}
    for corpus in range(5):
        kept = []
        for i in sorted(x for x in facts if x % 5 == corpus):
            key = lambda j: (re.sub("[^a-z0-9 ]+", " ", facts[j].lower()).strip(" ") or facts[j].lower().strip(" "))
            hit = next((k for k in kept if key(k[0]) == key(i)), None) or next((k for k in kept if same(k[0], i)), None)
            if hit:
                hit[1].append(i)
            else:
                kept.append((i, [i]))
        want |= {k: (corpus, " ".join(dict.fromkeys(f"s{j % 3}" for j in own)), len(own)) for k, own in kept}
    found = registry.QUERIES["greedy_fact_merge"](spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["corpus"], r["sources"], r["n_merged"]) for r in found} == want


def _parts_of(t):
    """The signature of a fact, as the predicate's test has it."""
    from recollect.functions import text as X

    words = {w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) >= 3} - set(X.STOP_WORDS)
    proper = {w.lower() for w in re.findall(r"\w+", t) if re.fullmatch("[A-Z][a-zA-Z]+", w)} - set(X.NOT_PROPER)
    subject = re.search("[A-Z][a-z]+", t)
    return frozenset(words), subject and subject[0].lower(), frozenset(proper)


def _same_fact(a, b):
    from recollect.functions import text as X

    def parts(t):
        tokens = {w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) >= 3 and w not in X.STOP_WORDS}
        subject = re.search("[A-Z][a-z]+", t)
        proper = {w.lower() for w in re.findall(r"\w+", t) if re.fullmatch("[A-Z][a-zA-Z]+", w)} - set(X.NOT_PROPER)
        return tokens, subject[0].lower() if subject else "", proper, tokens & set(X.SENTIMENT_VERBS)

    (x, s, p, u), (y, t, q, v) = parts(a), parts(b)
    if not x or not y or (s and t and s != t) or p != q:
        return False
    left, right = x - u, y - v
    shared = len(left & right)
    return len(x & y) >= 0.6 * len(x | y) or bool(u and v and shared >= 3 and shared / len(left | right) >= 0.25)


def test_packing_query_matches_a_plain_walk(spark):
    from recollect.plans import registry
    from recollect.schema import messages

    folder, budget = "/root/testdata/sf0.001", 600
    sessions = {}
    for r in messages(spark, folder).orderBy("session_no", "msg_no").collect():
        sessions.setdefault(r["session_no"], []).append((r["msg_no"], -(-len(r["text"] or "") // 4) + 1))
    want = []
    for number, rows in sessions.items():
        groups, used = [[rows[0]]], rows[0][1]
        for before, row in zip(rows, rows[1:], strict=False):
            if used + row[1] > budget and len(groups) < 16:
                groups.append([before] if before[1] + row[1] <= budget else [])
                used = sum(c for _, c in groups[-1])
            groups[-1].append(row)
            used += row[1]
        want += [(number, g, no) for g, own in enumerate(groups) for no, _ in own]
    got = [tuple(r) for r in registry.QUERIES["session_packing"](spark, folder).select("session_no", "group", "msg_no").collect()]
    assert sorted(got) == sorted(want) and max(g for _, g, _ in want) > 0


def test_chunking_query_keeps_every_message_within_budget(spark):
    import hashlib

    from recollect.operators import memory
    from recollect.plans import registry
    from recollect.schema import messages

    folder = "/root/testdata/sf0.001"
    texts = {r["id"]: r["text"] or "" for r in messages(spark, folder).collect()}
    got = {}
    for r in registry.QUERIES["message_chunking"](spark, folder).collect():
        got.setdefault(r["id"], []).append((r["chunk_no"], r["n_chars"], r["md5"]))
    assert set(got) == set(texts)
    for i, text in texts.items():
        at, chunks = 0, memory.cut_message(text, 120, 30)
        assert sorted(got[i]) == [(n, len(c), hashlib.md5(c.encode()).hexdigest()) for n, c in enumerate(chunks)]
        for n, c in enumerate(chunks):
            # each chunk begins where the one before ended, or up to its overlap earlier, and nothing is left out
            start = max(j for j in range(len(text) + 1) if text.startswith(c, j) and j <= at)
            assert memory.token_cost(c) <= 120 and (n == 0 or memory.token_cost(text[start:at]) <= 30)
            at = start + len(c)
        assert not text[at:].strip()


def test_fingerprints_tell_states_apart(spark, tmp_path):
    from recollect.sources import lenient

    (tmp_path / "a.jsonl").write_text("one")
    before = lenient.file_fingerprints(spark, str(tmp_path)).collect()
    (tmp_path / "a.jsonl").write_text("two")
    after = lenient.file_fingerprints(spark, str(tmp_path)).collect()
    assert [r["size"] for r in before] == [3] and before[0]["digest"] != after[0]["digest"]


def test_appended_evidence_matches_brute_force(spark):
    from recollect.plans import registry

    folder = "/root/testdata/sf0.001"
    facts = {r["doc_id"]: " ".join(re.split(r"\s+", r["text"] or "")[:8]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    even = [i for i in facts if i % 2 == 0]
    new = [a for a in facts if a % 2 and facts[a].strip(" ") and not any(a % 3 == b % 3 and _same_fact(facts[a], facts[b]) for b in even)]
    got = [r["doc_id"] for r in registry.QUERIES["evidence_append"](spark, folder).collect()]
    assert sorted(got) == sorted(even + new)


def test_rewrites_keep_what_they_must(spark, tmp_path):
    from recollect.operators import edits

    kind = "u int, content string, status string"
    good = spark.createDataFrame([(1, "a", "valid")], kind)
    mixed = good.unionByName(spark.createDataFrame([(1, "b", "rejected"), (2, "c", "repaired")], kind))
    folder = str(tmp_path / "evidence")
    assert edits.write_normalized(good, folder, "1") is None
    path = edits.write_normalized(mixed, folder, "1")
    assert sorted(r["content"] for r in spark.read.json(path).collect()) == ["a", "c"]
    assert [r["content"] for r in spark.read.json(f"{folder}/rejected/version=1").collect()] == ["b"]
    with pytest.raises(ValueError, match="fewer rows"):
        edits.guarded_rewrite(good, mixed, "u", str(tmp_path / "store"), "1")
    assert spark.read.json(edits.guarded_rewrite(mixed, good, "u", str(tmp_path / "store"), "2")).count() == 3
    assert spark.read.json(edits.write_summary(mixed.groupBy("u").count(), str(tmp_path / "sums"), "1")).count() == 2


def test_ingest_goes_on_after_a_crash(spark, tmp_path):
    """A batch that wrote its files and crashed before its commit writes the same files again."""
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for r in ("a", "b"):
        (tmp_path / "in" / f"{r}.json").write_text(json.dumps({"request_id": r, "user_id": "u", "session_id": "s", "messages": [{"role": "user", "content": r, "timestamp": 1}]}))
    ingest.append_messages(ingest.requests(spark, source), target, state).awaitTermination()
    # the commit of the batch is lost: the restarted run repeats it
    for name in (tmp_path / "state" / "commits").iterdir():
        name.unlink()
    ingest.append_messages(ingest.requests(spark, source), target, state).awaitTermination()
    assert sorted(r["content"] for r in spark.read.parquet(target).collect()) == ["a", "b"]


def _facts_frame(spark, texts):
    return spark.createDataFrame([(i, t, ["s"]) for i, t in enumerate(texts)], "k long, t string, s array<string>")


def test_links_move_no_long_signatures_and_list_no_pairs(spark, monkeypatch):
    """Links of classes alone with their proper nouns are not looked for; many near copies are compared in blocks."""
    rng = random.Random(3)
    near = [" ".join(["Tamsin", *(w if rng.random() > 0.1 else f"x{rng.randrange(9)}" for w in "grey heron keeps boats near the river bend every spring".split())]) for _ in range(90)]
    short = [" ".join(f"w{rng.randrange(30)}x" for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    told = [f"ruben {rng.choice(['praised', 'valued', 'kept'])} " + " ".join(rng.sample("oats pears plums corn rye figs dill sage".split(), 4)) for _ in range(60)]
    texts = [*near, *short, *told, *(f"Name{chr(65 + i % 26)}{chr(97 + i // 26)} stood alone" for i in range(40)), None, ""]
    facts = _facts_frame(spark, texts)
    sig = {}
    for i, t in enumerate(texts):
        sig.setdefault(_parts_of(t or ""), []).append(i)
    want = {own[0]: sum(_same_fact(texts[own[0]] or "", texts[other[0]] or "") for other in sig.values() if other is not own) for own in sig.values()}
    for most, block in ((2048, 256), (8, 5)):
        monkeypatch.setattr(resolve, "MEET_ALL", most)
        monkeypatch.setattr(resolve, "PER_BLOCK", block)
        got = resolve.near_dups(facts, "k", "t").collect()
        assert {r["k"]: (r["class_id"], r["n_links"]) for r in got} == {i: (own[0], want[own[0]]) for own in sig.values() for i in own}
        links = [tuple(r) for r in resolve.near_dup_links(facts, "k", "t")[1].collect()]
        assert len(links) == len(set(links)) == sum(want.values()) // 2 and all(a < b for a, b in links)
        placed = resolve._meeting(facts, resolve.signature_classes(facts, "k", "t")[1], "k", "t")
        assert not any("alone" in r["tokens"] for r in placed.collect())


def test_known_facts_never_meet_by_proper_nouns_alone(spark):
    """Many facts without proper nouns: the join has the rare tokens among its keys, and makes no pairs."""
    texts = [f"w{i}a w{i}b w{i % 7}c common words" for i in range(300)]
    new = _facts_frame(spark, [t + " more" if i % 3 else t for i, t in enumerate(texts)] + ["fresh thing", "", None])
    old = _facts_frame(spark, texts)
    out = resolve.not_yet_known(new, old, "k", "t", "s")
    assert sorted(r["k"] for r in out.collect()) == [300, 301, 302]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftSemi, .*\((x_)?t#\d+ = (y_)?t#\d+\)", plan)


def test_first_words(spark):
    from recollect.functions import text as X

    texts = ["", " ", "a", " a b", "a b ", "a  b\n\tc", "a b c d", " a b c", None, "a b c "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.first_words(F.col("t"), 3).alias("w"))
    got = {r["i"]: r["w"] for r in rows.collect()}
    assert got == {i: None if t is None else " ".join(re.split(r"\s+", t)[:3]) for i, t in enumerate(texts)}
