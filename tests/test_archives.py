"""Archives read by ranges, by many tasks."""

import random
import zipfile

import pytest

from tapewright.sources import archives, files


@pytest.fixture
def archive(tmp_path):
    r = random.Random(1)
    want = []
    with zipfile.ZipFile(tmp_path / "bulk.zip", "w") as z:
        z.writestr("data/", "")
        z.writestr("data/empty.csv", "")
        z.writestr("data/head.csv", "a,b\n")
        for i in range(12):
            rows = [(f"m{i}", f"v{r.random()}") for _ in range(r.randint(1, 400))]
            want += rows
            z.writestr(f"data/x/{i}.csv", "a,b\n" + "".join(f"{a},{b}\n" for a, b in rows), zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
        z.writestr("text.csv", 'a,b\n"one, two",NA\n')
        want.append(("one, two", "NA"))
    return tmp_path / "bulk.zip", sorted(want)


def test_one_archive_is_read_by_many_tasks(spark, archive):
    path, want = archive
    df = files.read_zipped(spark, f"{path.parent}/*.zip", "a string, b string", part_bytes=6000)
    assert sorted(map(tuple, df.collect())) == want
    assert df.rdd.getNumPartitions() > 4


def test_members_are_dealt_by_size(archive):
    path, _ = archive
    members = archives.members_of(str(path))
    assert len(members) == 14
    parts = archives.dealt(members, 5000)
    assert [m for p in parts for m in p.members] == sorted(members, key=lambda m: m.offset)
    assert all(len(p.members) == 1 or sum(m.packed for m in p.members) <= 5000 for p in parts)


def test_damage_is_found(spark, archive):
    path, _ = archive
    broken = bytearray(path.read_bytes())
    at = next(m for m in archives.members_of(str(path)) if m.name == "data/x/0.csv")
    broken[at.offset + 60] ^= 1
    path.write_bytes(broken)
    with pytest.raises(Exception, match="checksum"):
        files.read_zipped(spark, str(path), "a string, b string").collect()
