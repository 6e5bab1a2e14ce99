import gzip
import io
import random
import tarfile
import zipfile

import pytest

from tidemark.sources import archives as A

SCHEMA = "i int, name string, y double, extra int"


def text(rows, bom=False):
    return ("﻿" if bom else "") + "i,name,y\r\n" + "".join(f'{i},"{n}",{y}\r\n' for i, n, y in rows)


@pytest.fixture
def folder(tmp_path):
    a = [(1, "x, y", 0.5), (2, "two\nlines", "")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "no table")
        z.writestr("deep/er/train.csv", text(a, bom=True))
        z.writestr("t.csv", text([(99, "wrong", 1)]))
        z.writestr("empty.csv", "")
        z.writestr("bytes.bin", b"\xff\xfe\x00")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name, body in (("bb/long-name.csv", text([(98, "wrong", 1)])), ("c.csv", text([(3, "ü", "NaN")]))):
            data = body.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "c.csv").write_text(text([(4, "plain", 1e300)]))
    (tmp_path / "d.csv.gz").write_bytes(gzip.compress(text([(5, "zipped", 0.1)]).encode()))
    (tmp_path / "e.csv").write_text("other\n1\n")
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 cut off")
    return str(tmp_path)


def test_members_are_listed_with_their_headers(spark, folder):
    found = {(r["path"].rsplit("/", 1)[-1], r["member"]): r for r in A.members(spark, folder).collect()}
    assert found["a.zip", "deep/er/train.csv"]["header"] == ["i", "name", "y"]  # without the mark
    assert found["a.zip", "empty.csv"]["header"] == [] and found["a.zip", "bytes.bin"]["problem"]
    assert ("c.csv", "") in found and ("d.csv.gz", "") in found and len(found) == 11


def test_the_right_member_is_read_and_archives_need_not_be_the_same_kind(spark, folder):
    got = sorted(tuple(r) for r in A.read_archives(spark, folder, SCHEMA, "y").collect())
    assert got == [(1, "x, y", 0.5, None), (2, "two\nlines", None, None), (3, "ü", None, None), (4, "plain", 1e300, None), (5, "zipped", 0.1, None)]
    with pytest.raises(FileNotFoundError, match="nowhere"):
        A.read_archives(spark, folder, SCHEMA, "nowhere")


def test_values_of_another_type_are_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("i,y\none,2\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        A.read_archives(spark, str(tmp_path), SCHEMA, "y").collect()


def test_members_are_streamed(spark, tmp_path):
    """A member is a hundred times its archive, and no batch holds more than BATCH rows of it."""
    dice = random.Random(1)
    line = ",".join(str(dice.random()) for _ in range(20))
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("train.csv", "y,rest\n" + f'1,"{line}"\n' * 60_000)
    assert (tmp_path / "big.zip").stat().st_size * 100 < 60_000 * len(line)
    df = A.read_archives(spark, str(tmp_path), "y int, rest string", "y")
    assert df.selectExpr("sum(y)", "count(distinct rest)").first()[:] == (60_000, 1)
