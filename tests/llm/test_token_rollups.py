import random
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

import pytest

from skyledger.llm import registry, token_rollups as op
from skyledger.llm.common import table


def apply(state, rows):
    last = {}
    for key, tok, source, lang, n, kind, seq in rows:
        rank = (seq, kind == "delete", n or 0, source or "", lang or "")
        if (key, tok) not in last or rank > last[key, tok][0]:
            last[key, tok] = (rank, (source, lang, n or 0), kind)
    for where, (_, row, kind) in last.items():
        state.pop(where, None)
        if kind != "delete":
            state[where] = row
    return state


def sums(state):
    out = defaultdict(lambda: [0, 0])
    for (_, tok), (source, lang, n) in state.items():
        out[source, lang, tok][0] += 1
        out[source, lang, tok][1] += n
    return {k: tuple(v) for k, v in out.items()}


def batches(seed=1):
    rnd = random.Random(seed)
    one = lambda: (
        f"d{rnd.randrange(40)}", rnd.choice(["a", "b"]), rnd.choice(["s", "t", None]), rnd.choice(["en", None]),
        rnd.choice([0, 5, 17, None]), rnd.choice(["insert", "revise", "delete"]), rnd.randrange(3),
    )
    return [[one() for _ in range(n)] for n in (50, 0, 60, 60)]


def totals(spark, root):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in op.totals(spark, root).collect()}


def test_equals_brute_force_and_counts_once(spark, tmp_path):
    root, state = str(tmp_path), {}
    for k, rows in enumerate(batches()):
        frame = spark.createDataFrame([(*r, 1) for r in rows + rows[:3]], op.CHANGES + ", n_docs int")
        assert op.commit_batch(root, k, frame)
        assert not op.commit_batch(root, k, frame)
        state = apply(state, rows)
        assert totals(spark, root) == sums(state)
    assert {(r.doc_key, r.tokenizer) for r in op.ledger(spark, root).collect()} == set(state)


def test_a_half_done_batch_does_not_count_and_is_done_again(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path), batches()
    frames = [spark.createDataFrame(r, op.CHANGES) for r in rows]
    op.commit_batch(root, 0, frames[0])
    before = totals(spark, root)
    with monkeypatch.context() as broken:
        broken.setattr(op, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            op.commit_batch(root, 2, frames[3])
    assert totals(spark, root) == before
    op.commit_batch(root, 2, frames[2])
    assert totals(spark, root) == sums(apply(apply({}, rows[0]), rows[2]))


def test_late_batches_are_refused(spark, tmp_path):
    """Batches 1, 3, 2 of one document: the late one changes nothing."""
    root = str(tmp_path)
    one = lambda n: spark.createDataFrame([("d", "t", "s", "en", n, "revise", 0)], op.CHANGES)
    assert op.commit_batch(root, 1, one(10)) and op.commit_batch(root, 3, one(30))
    with pytest.raises(op.LateBatch):
        op.commit_batch(root, 2, one(20))
    assert totals(spark, root) == {("s", "en", "t"): (1, 30)} and op.committed(spark, root) == [1, 3]
    assert not op.commit_batch(root, 1, one(10))


@pytest.mark.parametrize("seed", [2, 3])
def test_any_order_is_refused_or_right(spark, tmp_path, seed):
    rnd, root, state, largest = random.Random(seed), str(tmp_path), {}, -1
    for k in [rnd.randrange(6) for _ in range(8)]:
        rows = batches(seed + k)[0][:20]
        frame = spark.createDataFrame(rows, op.CHANGES)
        if k in op.committed(spark, root):
            assert not op.commit_batch(root, k, frame)
        elif k < largest:
            with pytest.raises(op.LateBatch):
                op.commit_batch(root, k, frame)
        else:
            assert op.commit_batch(root, k, frame)
            state, largest = apply(state, rows), k
        assert totals(spark, root) == sums(state)


def test_a_commit_reads_the_last_snapshot_and_later_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "SNAPSHOT_AFTER", 2)
    root, state, read = str(tmp_path), {}, []
    folders = op.read_folders
    monkeypatch.setattr(op, "read_folders", lambda s, f, schema: read.append(len(f)) or folders(s, f, schema))
    for k in range(7):
        rows = batches(10 + k)[0][:25]
        op.commit_batch(root, k, spark.createDataFrame(rows, op.CHANGES))
        state = apply(state, rows)
        assert totals(spark, root) == sums(state)
    assert max(read) <= 3 and [c.action for c in op.commits(spark, root)].count("snapshot") >= 2


def test_of_two_writers_of_one_batch_one_counts(spark, tmp_path):
    root, rows = str(tmp_path), batches()[0]
    frame = spark.createDataFrame(rows, op.CHANGES)
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda _: op.commit_batch(root, 1, frame), range(3)))
    assert sorted(done) == [False, False, True] and totals(spark, root) == sums(apply({}, rows))


def test_query_over_no_documents(spark, small, tmp_path):
    table(spark, small, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.all_queries()["op9_token_rollups"](spark, str(tmp_path)).count() == 0


def test_nothing_committed(spark, tmp_path):
    assert totals(spark, str(tmp_path / "none")) == {}


def test_stream(spark, tmp_path):
    rows = batches(5)
    for k, part in enumerate(rows):
        spark.createDataFrame(part, op.CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(op.CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = stream.writeStream.foreachBatch(op.into_rollup(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c")
    run.trigger(availableNow=True).start().awaitTermination()
    assert len(op.committed(spark, f"{tmp_path}/out")) >= 1 and totals(spark, f"{tmp_path}/out")


def test_query_equals_brute_force(spark, small):
    encode = op._encoding(op.read_ranks()).encode_ordinary
    rows = sorted((str(r.doc_id), r.text, r.source, r.lang) for r in table(spark, small, "documents").collect())
    want, seen = defaultdict(lambda: [0, 0]), set()
    for _, text, source, lang in rows:
        if text not in seen:
            seen.add(text)
            for name, n in (("byte_bpe_50k", len(encode(text)) + 1), ("utf8_bytes", len(text.encode()))):
                want[source, lang, name][0] += 1
                want[source, lang, name][1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in registry.all_queries()["op9_token_rollups"](spark, small).collect()}
    assert got == dict(want)


def test_documents_without_id_text_or_source(spark):
    docs = spark.createDataFrame([(None, "a b", None, "en"), (None, "c", "s", None), (1, None, "s", "en"), (2, "", None, None)], "doc_id long, text string, source string, lang string")
    got = {r.doc_key: r.n_tokens for r in op.count_tokens(docs, op.read_ranks(), "v1").collect()}
    assert len(got) == 4 and sorted(got.values()) == [0, 0, 1, 2]
