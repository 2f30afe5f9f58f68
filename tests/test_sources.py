import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textmill.operators import bpe
from textmill.sources import corpus, runs
from textmill.streaming import corpus as streams


@pytest.fixture()
def shards(tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    n = 0
    for f in range(3):
        pq.write_table(pa.table({"text": [f"doc {n + k}" for k in range(10)], "other": list(range(10))}), folder / f"shard_{f:05d}.parquet", row_group_size=3)
        n += 10
    (folder / "shard_00009.parquet.tmp").write_text("no")
    return str(folder)


def test_split_by_file(spark, shards):
    assert corpus.read(spark, shards, "val").count() == 10 and corpus.read(spark, shards, "train").count() == 20
    assert {r.pf_idx for r in corpus.read(spark, shards, "val").collect()} == {2}
    assert [c for c in corpus.read(spark, shards).columns] == ["text", "path", "pf_idx", "row_index"]


def test_row_groups_by_rank_and_cursor(spark, shards):
    ranks = [corpus.row_groups(spark, shards, split="train", rank=r, world=2) for r in (0, 1)]
    assert {(x.pf_idx, x.rg_idx) for x in ranks[0].collect()} == {(0, 0), (0, 2), (1, 0), (1, 2)}
    assert ranks[0].unionByName(ranks[1]).count() == 20
    later = corpus.row_groups(spark, shards, split="train", rank=0, world=2, pf_idx=0, rg_idx=2)
    assert {(x.pf_idx, x.rg_idx) for x in later.collect()} == {(0, 2), (1, 0), (1, 2)}
    assert corpus.row_groups(spark, shards, rank=9, world=10).count() == 0


def test_small_files(spark, tmp_path):
    (tmp_path / "chat.jsonl").write_text(json.dumps([{"role": "user", "content": "a"}]) + "\n\nnot json\n")
    rows = corpus.conversations(spark, str(tmp_path / "chat.jsonl")).collect()
    assert len(rows) == 2 and sum(r.messages is not None and r.messages[0].content == "a" for r in rows) == 1
    (tmp_path / "b.csv").write_text("Eval Task,Random baseline\nt,25\n")
    assert corpus.baselines(spark, str(tmp_path / "b.csv")).first().percent == 25.0
    (tmp_path / "w.txt").write_text(" apple \npear\n")
    assert sorted(r.word for r in corpus.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["apple", "pear"]
    nested = spark.createDataFrame([((1, "x"),)], "train struct<a: int, b: string>")
    assert corpus.nested_rows(nested).columns == ["a", "b"]
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("icl_tasks:\n- {label: t, icl_task_type: multiple_choice, dataset_uri: u, num_fewshot: [3]}\n")
    assert corpus.task_config(spark, str(tmp_path / "c.yaml")).first().continuation_delimiter == " "


def test_runs(spark, tmp_path):
    vocab = bpe.vocabulary(spark, [(97, 98)])
    runs.save_vocabulary(vocab, str(tmp_path / "v"))
    assert runs.load_vocabulary(spark, str(tmp_path / "v")).where("token_id = 256").first().bytes == b"ab"
    meta = spark.createDataFrame([(7, (1, 2))], "step long, loop struct<a: int, b: int>")
    runs.save_meta(meta, str(tmp_path / "m"))
    assert runs.load_meta(spark, str(tmp_path / "m")).first().loop.b == 2
    names = spark.createDataFrame([("model_000010.pt",), ("model_9.pt",), ("meta_99.json",)], "name string")
    assert runs.latest_step(names).first().step == 10 and runs.latest_step(names.limit(0)).first().step is None
    log = spark.createDataFrame([("loss", "", 1.5, 1), ("bpb", "", 0.5, 1)], "tag string, key string, value double, step long")
    runs.log_metrics(log, str(tmp_path / "l"))
    assert runs.by_step(runs.metrics(spark, str(tmp_path / "l")), ["loss", "bpb"]).first().asDict() == {"step": 1, "loss": 1.5, "bpb": 0.5}
    assert runs.missing(names, names.limit(1)).count() == 2
    assert spark.range(1).select(runs.checkpoint_name(5), runs.checkpoint_name(5, 3)).first()[:] == ("meta_000005.json", "part_000005_rank03")


def test_stream_goes_on_where_it_stopped(spark, shards, tmp_path):
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    streams.keep_histogram(streams.arriving(spark, shards, files_per_trigger=1), out, at).awaitTermination()
    pq.write_table(pa.table({"text": ["doc new"]}), f"{shards}/shard_00003.parquet")
    streams.keep_histogram(streams.arriving(spark, shards), out, at).awaitTermination()
    got = {r.word: r.n for r in streams.summed_histogram(spark, out).collect()}
    assert got == {r.word: r.n for r in bpe.word_histogram(corpus.read(spark, shards)).collect()} and got["doc"] == 31
    assert spark.read.parquet(out).select(F.max("batch")).first()[0] >= 3


def test_landing_tries_again_and_skips_what_is_there(spark, tmp_path):
    from textmill.sources import runs

    folder = str(tmp_path / "land")

    def fetch(name):
        import os

        mark = f"{folder}/{name}.mark"
        if name == "never" or (name == "second" and not os.path.exists(mark)):
            open(mark, "w").close()
            raise OSError("not now")
        return name.encode()

    wanted = spark.createDataFrame([("first",), ("second",), ("never",), ("first",), (None,)], "name string")
    once = {r.name: (r.ok, r.tries) for r in runs.land(wanted, folder, fetch, tries=3).collect()}
    assert once == {"first": (True, 1), "second": (True, 2), "never": (False, 3)}
    again = {r.name: (r.ok, r.tries) for r in runs.land(wanted, folder, fetch, tries=1).collect()}
    assert again == {"first": (True, 0), "second": (True, 0), "never": (False, 1)}
    assert open(f"{folder}/second").read() == "second" and not list((tmp_path / "land").glob("*.tmp"))


def test_cursor_is_written_with_the_rows(spark, tmp_path):
    from textmill.sources import runs

    path = str(tmp_path / "steps")
    assert runs.cursor(spark, path) is None
    runs.advance(spark, path, spark.range(3), 0, 4, 0)
    runs.advance(spark, path, spark.range(3), 1, 2, 1)
    (tmp_path / "steps" / "at=2").mkdir()  # a step that broke off
    assert tuple(runs.cursor(spark, path)) == (1, 1, 2, 1)


def test_checkpoint_parts_by_rank(spark, tmp_path):
    from textmill.sources import runs

    path = str(tmp_path / "parts")
    runs.save_parts(spark.createDataFrame([(5, r, r * 10) for r in range(4)] + [(6, 0, 99)], "step int, rank int, x int"), path)
    assert [r.x for r in runs.load_parts(spark, path, 5, rank=2).collect()] == [20] and runs.load_parts(spark, path, 5).count() == 4
