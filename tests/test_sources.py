import gzip
import io
import json
import sqlite3
import struct
import tarfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather
import pytest
from pyspark.sql import functions as F

from loomframe.errors import InvalidArgument, SourceError
from loomframe.operators import image
from loomframe.plans import config, fluent
from loomframe.plans.catalogue import QUERIES  # noqa: F401  the queries must import
from loomframe.sources import binary, compression, jsondoc, registry, tabular
from loomframe.text import shards, tokenizers


def rows(df):
    return df.orderBy("idx").collect()


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes(b'\xef\xbb\xbfa,b,target\r\n"10",20,0\r\n30,"40",1\r\n')
    got = rows(tabular.csv(spark, str(f), label="target"))
    assert [(r.idx, r.input, r.label) for r in got] == [(0, [10, 20], 0), (1, [30, 40], 1)]
    f.write_text("a,b,c\n1.0,abc,0\n4,5,6\n")
    with pytest.raises(SourceError, match="abc.*float"):
        tabular.csv(spark, str(f))
    assert [(r.idx, r.input) for r in rows(tabular.csv(spark, str(f), errors="skip"))] == [(0, [4, 5])]
    f.write_text("a\tb\n1\tNA\n")
    assert rows(tabular.csv(spark, str(f), delimiter="\t", na="null"))[0].label is None
    with pytest.raises(InvalidArgument):
        tabular.csv(spark, str(f), delimiter="\t", label_index=5)


def test_json_lines_and_arrays(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    records = [{"id": f"img_{i}", "feat": {"a": i, "b": [i + 1.5, i + 2]}, "cls": ["cat", "dog"][i % 2], "ann": [{"bbox": [1, 2, 3, k]} for k in range(i % 3)], "note": None} for i in range(6)]
    f.write_text("\n".join(map(json.dumps, records)))
    fields = [jsondoc.Field("a", path="feat.a"), jsondoc.Field("b", path="feat.b[0]"), jsondoc.Field("cls", "label", dtype="bigint", categories=["cat", "dog"]), jsondoc.Field("boxes", "extra", "ann[*].bbox", rank=1), jsondoc.Field("id", "metadata"), jsondoc.Field("note", "extra")]
    got = rows(jsondoc.read(spark, str(f), fields))
    assert (got[5].input, got[5].cls, got[5].id, len(got[5].boxes)) == ([5, 6.5], 1, "img_5", 2) and got[3].boxes == [] and np.isnan(got[0].note)
    f.write_text(json.dumps({"data": {"items": [{"x": 1}, {"x": 2}]}}))
    assert [r.x for r in rows(jsondoc.read(spark, str(f), [jsondoc.Field("x")], records_path="data.items"))] == [1, 2]
    f.write_text('{"x": 1}\n{"x": \n{"y": 2}\n{"x": 4}\n')
    with pytest.raises(SourceError, match="record 1"):
        jsondoc.read(spark, str(f), [jsondoc.Field("x")])
    assert [r.x for r in rows(jsondoc.read(spark, str(f), [jsondoc.Field("x")], skip_invalid=True))] == [1, 4]
    assert [r.x for r in rows(jsondoc.read(spark, str(f), [jsondoc.Field("x", default=-1.0)], skip_invalid=True))] == [1, -1, 4]
    f.write_text("[1.0, 0]\n[3.0, 1]\n")
    assert [(r.input, r.label) for r in rows(tabular.jsonl_arrays(spark, str(f)))] == [([1], 0), ([3], 1)]
    schema = {"type": "object", "properties": {"p": {"type": "array", "items": {"type": "integer"}}, "label": {"type": "string", "enum": ["neg", "pos"], "x-role": "label"}}}
    assert [(x.name, x.role, x.rank) for x in jsondoc.fields_from_schema(schema)] == [("p", "input", 1), ("label", "label", 0)]


def test_text_parquet_sqlite_memory(spark, tmp_path):
    (tmp_path / "t.txt").write_text("hello world\n\nfoo\n")
    got = rows(tabular.text_lines(spark, str(tmp_path / "t.txt")))
    assert [(len(r.input), r.label) for r in got] == [(11, 0), (3, 1)]
    pd.DataFrame({"x": np.arange(20.0), "score": np.arange(20.0), "name": ["low"] * 10 + ["high"] * 10}).to_parquet(tmp_path / "p.parquet", row_group_size=10)
    kept = rows(tabular.parquet(spark, str(tmp_path / "p.parquet"), "x", predicates=[("score", "ge", 9)]))
    assert len(kept) == 11 and kept[0].input == [9] and kept[0].label == 0
    assert rows(tabular.parquet(spark, str(tmp_path / "p.parquet"), label="score"))[3].asDict() == {"idx": 3, "input": [3.0], "label": 3.0, "name": "low"}
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table t (a real, b text, y int)")
        db.executemany("insert into t values (?, ?, ?)", [(1.5, "2x", 0), (None, "z", 1)])
    assert [(r.input, r.label) for r in rows(tabular.sqlite(spark, str(tmp_path / "d.db"), "select * from t"))] == [([1.5, 2], 0), ([0, 0], 1)]
    assert rows(tabular.in_memory(spark, np.arange(3), None))[2].label == 2
    assert [r.y for r in rows(tabular.from_function(spark, 3, lambda i: (i * i,), "y long"))] == [0, 1, 4]
    assert [r.y for r in rows(tabular.generator(spark, lambda: ((k,) for k in range(3)), "y long"))] == [0, 1, 2]
    with pytest.raises(SourceError):
        tabular.hdf5(spark, "x")


@pytest.mark.parametrize("codec", ["gzip", "zlib", "zstd", "lz4", "bzip2", "xz"])
def test_codecs(codec):
    data = b"some bytes " * 500
    packed = compression.compress(data, codec)
    assert compression.opened(packed, ".zlib" if codec == "zlib" else "") == data and len(packed) < len(data)
    with pytest.raises(SourceError):
        compression.decompress(packed[: len(packed) // 2], codec)


def test_arrays(spark, tmp_path):
    x = np.arange(6, dtype=np.float32).reshape(3, 2)
    buffer = io.BytesIO()
    np.save(buffer, x)
    (tmp_path / "x.npy.gz").write_bytes(gzip.compress(buffer.getvalue()))
    got = rows(binary.npy(spark, str(tmp_path / "x.npy.gz")))
    assert [r.input for r in got] == x.tolist() and {r.label for r in got} == {0}
    np.savez_compressed(tmp_path / "z.npz", a=x, b=np.arange(2))
    assert {(r.name, tuple(r.shape)) for r in rows(binary.npz(spark, str(tmp_path / "z.npz")))} == {("a", (3, 2)), ("b", (2,))}
    pa.feather.write_feather(pa.table({"x": pa.array([1.0, None], pa.float32()), "s": ["a", "b"]}), str(tmp_path / "f.feather"), compression="uncompressed")
    got = rows(binary.arrow_ipc(spark, str(tmp_path / "f.feather"), "x float, s string"))
    assert got[0].x == 1 and np.isnan(got[1].x) and got[1].s == "b"


def test_idx_cifar_tar_wav(spark, tmp_path):
    n = 5
    (tmp_path / "i").write_bytes(struct.pack(">IIII", 2051, n, 28, 28) + bytes((i + p) & 255 for i in range(n) for p in range(784)))
    (tmp_path / "l").write_bytes(struct.pack(">II", 2049, n) + bytes(range(n)))
    got = rows(binary.mnist(spark, str(tmp_path / "i"), str(tmp_path / "l")))
    assert got[2].label == 2 and got[2].input[0] == 2 and got[2].shape == [28, 28, 1]
    (tmp_path / "c").write_bytes(b"".join(bytes([k]) + bytes(3072) for k in range(4)))
    assert [r.label for r in rows(binary.cifar(spark, str(tmp_path / "c")))] == [0, 1, 2, 3]
    picture = image.encode_png(np.arange(12, dtype=np.uint8).reshape(2, 2, 3))
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for name, body in (("a.png", picture), ("a.cls", b"7"), ("b.png", picture), ("b.cls", b"3")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    assert [(r.key, r.label, r.shape) for r in rows(binary.web_dataset(spark, str(tmp_path / "s.tar")))] == [("a", 7, [2, 2, 3]), ("b", 3, [2, 2, 3])]
    (tmp_path / "w.wav").write_bytes(binary.wav_bytes(np.zeros((8, 1), np.float32), 8000))
    assert rows(binary.wav(spark, str(tmp_path / "w.wav"), frames=10))[0].shape == [10, 1] == rows(binary.audio(spark, str(tmp_path / "w.wav"), frames=10))[0].shape
    with pytest.raises(SourceError, match="video"):
        binary.video(spark, "x")
    for cls in ("cat", "dog"):
        (tmp_path / "img" / cls).mkdir(parents=True)
        (tmp_path / "img" / cls / "x.png").write_bytes(picture)
    assert [r.label for r in rows(binary.image_folder(spark, str(tmp_path / "img")))] == [0, 1]


def test_copy_binary(spark, tmp_path):
    row = lambda x, name, y: struct.pack(">h", 3) + struct.pack(">id", 8, x) + struct.pack(">i", len(name)) + name + struct.pack(">ii", 4, y)
    data = binary.COPY_SIGNATURE + struct.pack(">II", 0, 0) + row(1.5, b"cat", 7) + row(2.5, b"dog", 8) + struct.pack(">h", -1)
    (tmp_path / "c.bin").write_bytes(data)
    got = rows(binary.copy_binary(spark, str(tmp_path / "c.bin"), [("x", "float64"), ("name", "text"), ("y", "int32")]))
    assert [(r.x, r.name, r.y) for r in got] == [(1.5, "cat", 7), (2.5, "dog", 8)]
    for bad in (data[:-2], data[5:], data[:25]):
        with pytest.raises(SourceError):
            list(binary.copy_rows(bad, ["float64", "text", "int32"]))


def test_images(spark):
    x = np.random.default_rng(0).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (image.decode(image.encode_png(x)) == x).all() and image.decode(image.encode_png(x), "gray").shape == (5, 7, 1)
    none = np.zeros(4, np.uint32)
    assert (image.resize(5, 7)(x, none) == x).all() and image.resize(10, 3, "nearest")(x, none).shape == (10, 3, 3)
    assert image.normalize([0.5] * 3, [0.5] * 3)(x, none).min() >= -1
    with pytest.raises(SourceError):
        image.decode(b"\xff\xd8\xff\xe0")
    df = spark.createDataFrame([(k, [5, 7, 3], bytearray(x.tobytes()), 0) for k in range(8)], "idx long, shape array<int>, input binary, label long")
    once = [r.data for r in rows(image.apply(df, image.random_crop(3, 3), image.random_flip(), seed=1))]
    assert once == [r.data for r in rows(image.apply(df.repartition(5), image.random_crop(3, 3), image.random_flip(), seed=1))] and len({tuple(d) for d in once}) > 1
    formats = spark.createDataFrame([(bytearray(image.encode_png(x)),), (bytearray(b"fLaC123"),), (bytearray(b"?"),)], "c binary").select(binary.media_format(F.col("c")).alias("m")).collect()
    assert [r.m for r in formats] == ["png", "flac", "unknown"]


def test_tokenizers(spark, tmp_path):
    assert tokenizers.Bpe({"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4}, [("a", "b"), ("ab", "c")]).encode("abc") == [4]
    assert tokenizers.WordPiece({"[UNK]": 0, "un": 1, "##want": 2, "##ed": 3}).encode("unwanted zzz unwanx") == [1, 2, 3, 0, 1, 0]
    assert tokenizers.Unigram([("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -0.6), ("abc", -0.2)]).encode("abc") == [4]
    df = spark.createDataFrame([("the cat sat on the mat, the cat's hat",), ("naïve café 12345",), (None,)], "t string")
    bpe = tokenizers.train(df, "t", 290, special=["<s>"])
    text = "<s>the naïve cat's 日本 hat"
    assert bpe.decode(bpe.encode(text)) == text and bpe.encode("<s>") == [0] and len(bpe.encode("the")) < 3
    bpe.save(str(tmp_path / "v"))
    again = tokenizers.ByteBpe.load(str(tmp_path / "v"))
    assert again.ranks == bpe.ranks and again.digest() == bpe.digest()
    stream = tokenizers.StreamDecoder(bpe)
    assert "".join(stream.push(i) for i in bpe.encode("café 日")) + stream.finish() == "café 日"
    whole = df.select(tokenizers.tokens(bpe, "t").alias("x")).collect()
    assert whole[2].x is None and bpe.decode(whole[0].x).startswith("the cat")


def test_byte_bpe_agrees_with_tiktoken():
    tiktoken = pytest.importorskip("tiktoken")
    bpe = tokenizers.learn([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3), (" low", 9), (" newer", 7)], 300)
    order = {p: k for k, p in enumerate(bpe.ranks)}
    oracle = tiktoken.Encoding("t", pat_str=tokenizers.PATTERNS["gpt2"], mergeable_ranks=order, special_tokens={})
    ours = tokenizers.ByteBpe(order)
    for text in ("lowest newer low lower", "  x\n\nwidest  ", "a" * 400, "é日本" * 5):
        assert ours.encode(text) == oracle.encode(text)


def test_shards_and_streams(spark, tmp_path):
    docs = spark.createDataFrame([(k, [k % 7] * (k % 5 + 1)) for k in range(40)], "doc long, tokens array<int>")
    manifest = shards.write_shards(docs, str(tmp_path / "s"), 100, 3, eos=99)
    manifest.save(str(tmp_path / "s" / "manifest.json"))
    loaded = shards.Manifest.load(str(tmp_path / "s" / "manifest.json"))
    assert loaded.verify(spark) == [] and sum(s["docs"] for s in loaded.shards) == 40
    assert shards.read_shards(spark, str(tmp_path / "s" / "*.tok")).count() == 40
    stream = shards.TokenStream([100, 50, 7, 33], 8, 3)
    table = [(r.position, r.epoch, r.shard, r.window) for r in stream.table(spark, 2).orderBy("position").collect()]
    assert len({t[1:] for t in table}) == 2 * stream.per_epoch and [t[0] for t in table] == list(range(2 * stream.per_epoch))
    assert [(r.position, r.epoch, r.shard, r.window) for r in stream.table(spark, 2, start=5).orderBy("position").collect()] == table[5:]
    state = stream.state(11)
    assert shards.State.of(state.text()) == state
    ranks = [shards.TokenStream([100, 50, 7, 33], 8, 3, r, 3).table(spark, 2).collect() for r in range(3)]
    assert sorted((r.position, r.epoch, r.shard, r.window) for part in ranks for r in part) == table
    mixture = shards.Mixture([stream, shards.TokenStream([200], 8, 4)], [1.0, 3.0], 9).table(spark, 500)
    first = mixture.where("source = 0").orderBy("position").limit(10).collect()
    assert [(r.epoch, r.shard, r.window) for r in first] == [t[1:] for t in table[:10]]
    assert abs(mixture.where("source = 1").count() - 375) < 50


def test_packing_places_each_document_once():
    lengths = np.random.default_rng(3).integers(1, 120, 300).tolist()
    bins = shards.best_fit_pack(lengths, 100)
    assert sorted(d for b in bins for d in b) == list(range(300))
    assert all(len(b) == 1 or sum(lengths[d] for d in b) <= 100 for b in bins)
    assert shards.best_fit_pack([5, 3, 8, 2, 10, 4], 10) == [[4], [2, 3], [0, 5], [1]]


def test_pipeline_documents(spark, tmp_path):
    (tmp_path / "d.csv").write_text("x,y\n0.5,1\n2,0\n-1,3\n")
    text = f"source:\n  type: csv\n  path: {tmp_path}/d.csv\n  options: {{label: y}}\npreprocessors:\n  - type: standard_scaler\ntransforms:\n  - type: clip\n    params: {{min: -1, max: 1}}\nloader:\n  batch_size: 2\n"
    loader = config.build(spark, config.parse(text))
    got = list(loader)
    assert [b.size for b in got] == [2, 1] and got[0].inputs[1][0] == pytest.approx(1.0) and got[0].labels == [1, 0]
    assert config.parse(json.dumps({"a": [1]})) == {"a": [1]}
    shuffled = config.Loader(loader.rows, loader.columns, 3, shuffle=True, seed=1)
    assert sorted(shuffled.epoch(0).first().labels) == [0, 1, 3]
    bad = config.parse(text.replace("clip", "nothing"))
    with pytest.raises(InvalidArgument, match="transform 'nothing'"):
        config.build(spark, bad)
    with pytest.raises(InvalidArgument, match="source"):
        config.build(spark, {"source": {"type": "csv"}})
    config.save_snapshot(str(tmp_path / "s.json"), loader.fitted, [{"type": "clip", "params": {"min": -10, "max": 10}}])
    step = config.load_snapshot(str(tmp_path / "s.json"), ["f0"])
    assert step(spark.createDataFrame([(0.5,)], "f0 double")).first().f0 == pytest.approx(0.0)


def test_fluent_and_registry(spark, tmp_path, monkeypatch):
    (tmp_path / "d.csv").write_text("x,y\n1,0\n2,1\n3,0\n4,1\n")
    chain = fluent.from_csv(spark, str(tmp_path / "d.csv")).filter("label = 1").shuffle(3).prefetch(2).batches(2)
    assert sorted(next(iter(chain.build())).inputs) == [[2], [4]]
    assert registry.open_uri(spark, f"csv://{tmp_path}/d.csv").count() == 4
    (tmp_path / "loom_plugin_demo.py").write_text("from loomframe.sources.registry import register\n\n\n@register('ten')\ndef ten(spark, path):\n    return spark.range(10)\n")
    monkeypatch.syspath_prepend(tmp_path)
    assert registry.load_plugin("loom_plugin_demo") == ["ten"] and registry.open_uri(spark, "ten:x").count() == 10
    for bad in (lambda: registry.open_uri(spark, "nope:x"), lambda: registry.register("csv")(tabular.csv)):
        with pytest.raises(InvalidArgument):
            bad()


def test_streams_equal_batches(spark, tmp_path):
    from loomframe import streaming
    from loomframe.operators import transforms

    df = spark.createDataFrame([(k, float(k)) for k in range(20)], "idx long, x double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    step = transforms.compose(transforms.clip(["x"], 3, 15), transforms.log1p(["x"]))
    streaming.run_once(streaming.table(spark, str(tmp_path / "in"), "idx long, x double"), step, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(step(df).collect())
