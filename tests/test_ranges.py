"""Sequence files read in byte ranges equal their whole reading."""

import bz2
import gzip
import io
import lzma
import random
import shutil
import subprocess

import pytest

from cladeloom.sources import fasta, ranges


def text(n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.choice([0, 3, 40, 400])))
        out.append(f">p{i} note é{i}\n" + "\n".join(seq[j : j + 50] for j in range(0, len(seq), 50)) + rng.choice(["\n", "\n\n", "\r\n"]))
    return "".join(out).encode()


def expected(data):
    got = []
    for r in data.decode().removeprefix(">").split("\n>"):
        head, _, body = r.partition("\n")
        got.append((head.strip(), body.translate({ord(c): None for c in " \t\r\n>"})))
    return got


def pieces(data, size):
    return [data[i : i + size] for i in range(0, len(data), size)]


def packed(data):
    blocks = [
        ("plain", data),
        ("one.gz", gzip.compress(data)),
        ("many.gz", b"".join(gzip.compress(x) for x in pieces(data, 333))),
        ("stored.bin", b"".join(gzip.compress(x, 0) for x in pieces(data, 777))),
        ("padded.gz", b"".join(gzip.compress(x) for x in pieces(data, 999)) + b"\0" * 700),
        ("many.bz2", b"".join(bz2.compress(x) for x in pieces(data, 555))),
        ("many.xz", b"".join(lzma.compress(x) for x in pieces(data, 1111)) + b"\0" * 8),
    ]
    if shutil.which("xz"):
        blocks.append(("blocks", subprocess.run(["xz", "-c", "--block-size=700"], input=data, stdout=subprocess.PIPE, check=True).stdout))
    return blocks


@pytest.mark.parametrize("split", [97, 1 << 20])
def test_ranges_equal_whole_files(spark, tmp_path, split):
    data = text()
    files = packed(data)
    for name, content in files:
        (tmp_path / name).write_bytes(content)
    got = [(r.header, r.seq) for r in fasta.read_fasta(spark, str(tmp_path), split=split).orderBy("ord").collect()]
    assert got == expected(data) * len(files)


def test_several_tasks_share_a_file_of_many_members():
    """Every member is some range's, and no range has them all."""
    data = text(200)
    for content in (b"".join(gzip.compress(x) for x in pieces(data, 3000)), b"".join(lzma.compress(x) for x in pieces(data, 3000))):
        f = io.BytesIO(content)
        shares = [b"".join(ranges.text_of(f, s, min(s + 2000, len(content)), len(content))) for s in range(0, len(content), 2000)]
        assert b"".join(shares) == data and sum(1 for x in shares if x) > 5


def test_members_inside_members_and_false_starts():
    """What looks like a member inside another does not count; cut files are errors."""
    inner = b"\x1f\x8b\x08\x00" * 50 + b"BZh91AY&SY" * 20
    content = gzip.compress(inner, 0) + gzip.compress(b"end")
    f = io.BytesIO(content)
    shares = [b"".join(ranges.text_of(f, s, min(s + 16, len(content)), len(content))) for s in range(0, len(content), 16)]
    assert b"".join(shares) == inner + b"end"
    with pytest.raises(EOFError):
        b"".join(ranges.text_of(io.BytesIO(content[:-30]), 0, 10_000, len(content) - 30))
    with pytest.raises(ValueError):
        b"".join(ranges.text_of(io.BytesIO(content + b"junk"), 0, 10_000, len(content) + 4))


def test_starts_on_the_edge_of_parts():
    whole = b">a\nAC\n>b\nGT\n\n>c\n>d\n"
    want = whole.split(b"\n>")
    for n in range(1, 7):
        kinds, got = zip(*ranges.cut(iter(pieces(whole, n))))
        assert list(got) == want and kinds == (0, 1, 1, 2)
    assert list(ranges.cut(iter([]))) == [] and list(ranges.cut(iter([b"AC\n"]))) == [(0, b"AC\n")]


def test_many_files_and_empty_ones(spark, tmp_path):
    """The driver opens none of them, and an empty file has no records."""
    for i in range(300):
        (tmp_path / f"f{i:03}.fa").write_bytes(b"" if i % 7 == 0 else f">x{i}\nACD\n".encode())
    got = [r.id for r in fasta.read_fasta(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [f"x{i}" for i in range(300) if i % 7]
    assert fasta.read_fasta(spark, str(tmp_path / "f000.fa")).count() == 0
    assert fasta.read_fasta(spark, str(tmp_path / "f001.fa"), str(tmp_path / "f001.fa")).count() == 2


def test_tasks_follow_bytes(spark, tmp_path, monkeypatch):
    """Many small ranges are few tasks, and a task opens a file once."""
    text = "".join(f">r{i} x\n{'ACDEFGHIKL' * 30}\n" for i in range(400))
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(text.replace(">r", ">s").encode()))
    seen = []
    settled = ranges.settle

    def spy(df, name):
        if name == "read":
            seen.append(df.rdd.getNumPartitions())
        return settled(df, name)

    monkeypatch.setattr(ranges, "settle", spy)
    got = fasta.read_fasta(spark, str(tmp_path / "*"), split=512)
    assert sorted(r.id for r in got.collect()) == sorted(f"{c}{i}" for c in "rs" for i in range(400))
    assert seen and seen[0] <= 2 * spark.sparkContext.defaultParallelism
