import json
import os

import pytest

from lexiforge import cli
from lexiforge.operators import feed
from lexiforge.plans import build
from lexiforge.plans.generations import StaleBase, Store
from lexiforge.sources import adapters, files
from lexiforge.streaming import feed_stream, watch


def write(root, **contents):
    for name, text in contents.items():
        path = os.path.join(root, name.replace("__", "/").replace("_dot_", "."))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


def test_source_lists_what_the_index_admits(spark, tmp_path):
    root = str(tmp_path / "c")
    write(root, a_dot_txt="x y", _dot_hidden_dot_mod="module h", _dot_git__k_dot_md="# k", b_dot_exe="no", empty_dot_md="")
    os.symlink(os.path.join(root, "a.txt"), os.path.join(root, "l.txt"))
    assert sorted(r["path"] for r in files.read(spark, root).collect()) == [".git/k.md", ".hidden.mod", "a.txt", "empty.md"]
    assert files.listed(root)[1] == 2
    with pytest.raises(ValueError, match="no such folder"):
        files.listed(root + "/none")


def test_publish_load_check_reclaim(spark, tmp_path):
    root, store = str(tmp_path / "c"), Store(spark, str(tmp_path / "s"))
    write(root, a_dot_mod="module m.a\nuse m.b\n", b_dot_md="# B\n")
    assert store.head() is None
    first = build.full(files.read(spark, root), rich=True)
    assert store.publish(first) == 0
    with pytest.raises(StaleBase):
        store.publish(first)
    write(root, c_dot_txt="new words")
    assert watch.refresh(spark, root, store, rich=True) == 1
    assert watch.refresh(spark, root, store, rich=True) is None
    assert store.manifest(1)["identity"] == build.full(files.read(spark, root), rich=True).identity
    assert store.check() == [] and store.verified(0)
    found = store.lookup()
    assert found.term_substring("word").total == 1 and found.headings_for("b.md").records.first()["title"] == "B"
    assert json.loads(found.provenance("c.txt").toJSON().first())["established_generation"] == 1
    assert found.provenance("none").first()["found"] is False
    answer = found.all_docs(limit=2)
    assert (answer.total, answer.limited, answer.records.count()) == (3, True, 2)
    os.makedirs(tmp_path / "s" / ".staging-x")
    assert ("ORPHAN_TMP", ".staging-x") in store.check() and store.repair() == [".staging-x"]
    assert store.reclaim(0) == [0] and store.generations() == [1] and store.metrics()["amplification"] == 1


def test_watch_publishes_changes(spark, tmp_path):
    root, store = str(tmp_path / "c"), Store(spark, str(tmp_path / "s"))
    write(root, a_dot_txt="one")
    q = watch.watch(spark, root, store, str(tmp_path / "k"))
    try:
        q.processAllAvailable()
        assert store.head() == 0
        write(root, b_dot_txt="two")
        q.processAllAvailable()
        assert store.head() == 1
    finally:
        q.stop()


def test_command_line(spark, tmp_path, capsys):
    root, store = str(tmp_path / "c"), str(tmp_path / "s")
    write(root, a_dot_txt="alpha beta", b_dot_txt="gamma")
    assert cli.main(["query", "--store", store], spark) == 1
    assert cli.main(["build", "--corpus", root, "--store", store], spark) == 0
    assert cli.main(["build", "--corpus", root, "--store", store, "--incremental"], spark) == 0
    capsys.readouterr()
    assert cli.main(["query", "--store", store, "--term-substring", "alph"], spark) == 0
    head, row = capsys.readouterr().out.strip().split("\n")
    assert json.loads(head)["total"] == 1 and json.loads(row)["path"] == "a.txt"
    assert cli.main(["check", "--store", store], spark) == 0 and cli.main(["reclaim", "--store", store], spark) == 0


def relation(kind, source, target, generation, ordinal=0):
    return b"MR\x01\x00" + bytes([kind, 0, 0, 0]) + source.ljust(12, b".") + target.ljust(12, b".") + generation.to_bytes(8, "big") + bytes(32) + ordinal.to_bytes(8, "big")


def test_feed(spark):
    raws = [relation(1, b"a", b"x", 1), relation(1, b"a", b"x", 3), relation(1, b"a", b"x", 2), relation(4, b"b", b"x", 2**63 + 5), relation(2, b"c", b"y", 1)]
    df = spark.createDataFrame(list(enumerate(raws)), "position long, raw binary")
    state = feed.latest(feed.decoded_relations(df))
    assert sorted(int(r["generation"]) for r in state.collect()) == [1, 3, 2**63 + 5]
    assert feed.selected(state, target=b"x".ljust(12, b".")).count() == 2
    assert feed.result_identity(state).first() == feed.result_identity(state.repartition(3)).first()
    assert feed.serial_result_identity(state) == feed.serial_result_identity(state.repartition(3))
    with pytest.raises(Exception, match="invalid relation"):
        feed.decoded_relations(spark.createDataFrame([(0, raws[0][:79])], "position long, raw binary")).collect()
    commits = feed.decoded_relations(df.withColumn("commit", df["position"] + 1))
    p = feed.Projection.rebuilt(commits)
    assert p.freshness() == ("complete", True) and p.observed(9).freshness() == ("stale", False)
    assert p.answered(4, target=b"x".ljust(12, b".")).count() == 2
    with pytest.raises(ValueError, match="complete through"):
        p.observed(9).answered()
    with pytest.raises(ValueError, match="complete through"):
        p.destroyed().answered(1)


def commit(generation, relations, provenances=0):
    return b"MC\x01\x00" + generation.to_bytes(8, "big") + b"".join(n.to_bytes(4, "big") for n in (1, relations, provenances)) + bytes(32)


def provenance(generation):
    return b"MP\x01\x00" + b"s" * 12 + b"p" * 12 + b"t" * 12 + generation.to_bytes(8, "big") + bytes(64)


def test_commits_are_checked_and_applying_equals_rebuilding(spark):
    make = lambda decode, raws: decode(spark.createDataFrame(list(enumerate(raws)), "position long, raw binary"))
    commits = {1: [relation(1, b"a", b"x", 1), relation(2, b"c", b"y", 1)], 2: [relation(1, b"a", b"x", 2)], 5: [relation(1, b"a", b"x", 5, 1), relation(2, b"c", b"y", 5)]}
    p, every = feed.Projection(), None
    for g, raws in commits.items():
        p = p.applied(make(feed.decoded_relations, raws), make(feed.decoded_commits, [commit(g, len(raws))]))
        rows = make(feed.decoded_relations, raws).selectExpr("*", f"{g} AS commit")
        every = rows if every is None else every.unionByName(rows)
    whole = feed.Projection.rebuilt(every)
    assert (p.through, whole.through) == (5, 5)
    a, b = (x.state.select(*feed.IDENTITY, "raw", "generation") for x in (p, whole))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == 3
    one = make(feed.decoded_relations, [relation(2, b"c", b"y", 7)])
    found = p.applied(one, make(feed.decoded_commits, [commit(7, 1, 1)]), make(feed.decoded_provenance, [provenance(7)]))
    assert found.through == 7 and found.state.count() == 3
    for record, rows in ((commit(8, 1), one), (commit(7, 2), one), (commit(7, 1, 1), one)):  # another generation, another number, no provenance
        with pytest.raises(ValueError, match="not those"):
            p.applied(rows, make(feed.decoded_commits, [record]))
    with pytest.raises(ValueError, match="advance"):
        p.applied(make(feed.decoded_relations, [relation(1, b"a", b"x", 5)]), make(feed.decoded_commits, [commit(5, 1)]))
    row = make(feed.decoded_provenance, [provenance(9)]).first()
    assert (bytes(row["producer"]), int(row["generation"])) == (b"p" * 12, 9)


def test_hints_wait_for_quiet_and_are_repeated_for_validation(tmp_path):
    write(str(tmp_path), a_dot_txt="one")
    reader, at, seen = watch.HintReader({"path": str(tmp_path), "quietpolls": "1", "validateevery": "4"}), {}, []
    at = reader.initialOffset()
    for step in range(9):
        if step == 3:
            write(str(tmp_path), b_dot_txt="two")
        if step == 4:
            write(str(tmp_path), c_dot_txt="three")  # still in the burst
        rows, at = reader.read(at)
        seen.append(len(list(rows)))
    assert seen == [0, 1, 0, 0, 0, 1, 0, 0, 0] and reader.read(at)[1]["polls"] == 0  # the fourth poll since the last hint validates


def test_a_head_that_moves_is_tried_again(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path / "c"), Store(spark, str(tmp_path / "s"))
    write(root, a_dot_txt="one")
    real, calls = store.publish, []

    def publish(snapshot, base=None):
        calls.append(base)
        if len(calls) == 1:
            raise StaleBase("another one was first")
        return real(snapshot, base)

    monkeypatch.setattr(store, "publish", publish)
    assert watch.refresh(spark, root, store) == 0 and len(calls) == 2
    monkeypatch.setattr(store, "publish", lambda *a: (_ for _ in ()).throw(StaleBase("always")))
    write(root, b_dot_txt="two")
    with pytest.raises(StaleBase):
        watch.refresh(spark, root, store, attempts=2)


def test_head_faults_are_found(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    (tmp_path / "s" / "HEAD").write_text("not json")
    assert [c for c, _ in store.check()] == ["HEAD_MALFORMED"]
    (tmp_path / "s" / "HEAD").write_text('{"generation": 3}')
    assert [c for c, _ in store.check()] == ["HEAD_DANGLING"]


def test_feed_stream_equals_batch(spark, tmp_path):
    df = adapters.rows(spark, "/root/testdata/sf0.001", adapters.FEED).select("position", "raw")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = feed_stream.to_memory(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "feed_state")
    q.awaitTermination(120)
    mine = spark.table("feed_state").select(*feed.IDENTITY, "raw")
    batch = feed.latest(feed.decoded_relations(df)).select(*feed.IDENTITY, "raw")
    assert mine.exceptAll(batch).isEmpty() and batch.exceptAll(mine).isEmpty()
