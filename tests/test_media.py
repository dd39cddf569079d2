import io
import struct
import zipfile

import numpy as np

from meridia.operators.encode import encode
from meridia.sources import media, ranged


def test_wav(spark):
    clip = np.sin(np.arange(200) / 5)
    sound = media.wav_bytes(clip, 8000)
    files = spark.createDataFrame([("x.wav", bytearray(sound)), ("bad.wav", bytearray(b"RIFF"))], "path string, content binary")
    got = {r.path: r for r in media.decode_wav(files).collect()}
    assert np.allclose(got["x.wav"].samples, clip, atol=1e-4) and got["bad.wav"].error


def test_headers_read_little(spark, tmp_path):
    """Whole, cut, foreign, empty and missing files, other chunks before the samples, and odd names."""
    sound = media.wav_bytes(np.zeros(100_000), 16000)
    listed = sound[:36] + b"LIST" + struct.pack("<I", 5) + b"abcde\0" + sound[36:]
    files = {"a b%.wav": sound, "cut.wav": sound[:5000], "list.wav": listed, "none.wav": b"", "text.wav": b"hello, this is no sound", "head.wav": sound[:40], "no data.wav": sound[:36]}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = spark.read.format("binaryFile").load(str(tmp_path)).select("path").unionByName(spark.createDataFrame([(f"{tmp_path}/gone.wav",), (f"{tmp_path}/none.wav",), (None,)], "path string"))
    got = {r.path.rsplit("/", 1)[1]: r for r in ranged.wav_headers(found).collect()}
    ok = (100_000, 16000, 1, 16, 6.25)
    by = lambda r: (r.frames, r.samplerate, r.channels, r.bits, r.duration_sec)
    assert got["a%20b%25.wav" if "a%20b%25.wav" in got else "a b%.wav"].state == "ok" and by(got["list.wav"]) == ok and got["list.wav"].size_bytes == len(listed)
    assert {k: (r.state, r.error) for k, r in got.items() if r.state != "ok"} == {
        "cut.wav": ("error", "cut short"), "none.wav": ("error", "not a WAV file"), "text.wav": ("error", "not a WAV file"),
        "head.wav": ("error", "no samples"), "no data.wav": ("error", "no samples"), "gone.wav": ("missing", None),
    }
    assert max(r.bytes_read for r in got.values()) <= 64


def test_archives(spark, tmp_path):
    pack = io.BytesIO()
    with zipfile.ZipFile(pack, "w") as z:
        z.writestr("a/x.wav", b"sound" * 100)
        z.writestr("note.txt", "no")
        z.writestr("dir/", "")
    (tmp_path / "p.zip").write_bytes(pack.getvalue() + b"\n")
    (tmp_path / "bad.zip").write_bytes(b"PK no")
    listed = ranged.zip_listing(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r.path[-5:], r.member or "", r["size"], r.error) for r in listed) == [("d.zip", "", None, "BadZipFile"), ("p.zip", "a/x.wav", 500, None), ("p.zip", "note.txt", 2, None)]
    path = next(r.path for r in listed if r.member)
    asked = spark.createDataFrame([(path, "a/x.wav"), (path, "note"), (path, None), (path + "no", "x")], "path string, member string")
    got = {r.member: (bytes(r.content) if r.content else None, r.error) for r in ranged.zip_members(asked).collect()}
    assert got == {"a/x.wav": (b"sound" * 100, None), "note": (None, "KeyError"), "x": (None, "FileNotFoundError")}


def test_encoder_contract(spark):
    t = spark.createDataFrame([(1, [float(i % 7) for i in range(40)]), (2, [1.0])], "clip_id long, samples array<double>")
    rows = encode(t).collect()
    assert sorted(r.segment_idx for r in rows) == [0, 1, 2, 3] and all(abs(np.linalg.norm(r.embedding) - 1) < 1e-9 for r in rows)
