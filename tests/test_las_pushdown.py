"""What a LAS read opens and returns when bounds and columns are asked for."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from scanforge.sources import binary


class Counted:
    """A file system that counts the bytes its files give."""

    def __init__(self, system, seen):
        self.system, self.seen = system, seen

    def get_file_info(self, what):
        return self.system.get_file_info(what)

    def open_input_file(self, path):
        source, seen = self.system.open_input_file(path), self.seen

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                source.close()

            def read_at(self, n, at):
                seen[path.rsplit("/", 1)[1]] = seen.get(path.rsplit("/", 1)[1], 0) + n
                return source.read_at(n, at)

        return File()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Four scans of a thousand points side by side along X."""
    out = tmp_path_factory.mktemp("las")
    rng = np.random.default_rng(0)
    frames = [pd.DataFrame({"scan_id": f"s{k}", "point_id": np.arange(1000), "X": rng.random(1000) + 10 * k, "Y": rng.random(1000) * 10, "Z": rng.random(1000), "Intensity": np.arange(1000) % 7, "class_id": k + 1, "r": 1, "g": 2, "b": 3}) for k in range(4)]
    binary.write_scans(spark.createDataFrame(pd.concat(frames)), str(out)).collect()
    return str(out), pd.concat(frames)


def test_bounds_skip_files_and_columns_are_not_decoded(folder, monkeypatch):
    path, points = folder
    seen = {}
    plain = binary._open
    monkeypatch.setattr(binary, "_open", lambda uri: (Counted(plain(uri)[0], seen), plain(uri)[1]))
    monkeypatch.setattr(binary, "RUN_BYTES", 10_000)  # several tasks a file
    reader = binary.LasReader(path, ["X", "Y", "class_id"])
    kept = list(reader.pushFilters([GreaterThan(("X",), 10), LessThanOrEqual(("X",), 11.0), LessThanOrEqual(("Y",), 2), EqualTo(("class_id",), 2)]))
    assert len(kept) == 4  # Spark filters again
    parts = reader.partitions()
    assert not seen and len(parts) == 4 * 4  # planned from the listing alone
    batches = [b for p in parts for b in reader.read(p)]
    assert all(b.schema.names == ["X", "Y", "class_id"] for b in batches)
    want = points[(points.X >= 10) & (points.X <= 11) & (points.Y <= 2)]
    assert abs(sum(b.num_rows for b in batches) - len(want)) <= 2  # rounding to millimetres
    assert {f: n for f, n in seen.items() if f != "s1.las"} == {f"s{k}.las": 4 * 375 for k in (0, 2, 3)}  # headers only
    assert seen["s1.las"] == 4 * 375 + 1000 * 34
    everything = binary.LasReader(path, ["point_id"])
    ids = np.concatenate([b.column("point_id").to_numpy() for p in everything.partitions() for b in everything.read(p)])
    assert sorted(ids) == sorted(list(range(1000)) * 4)


def test_pushed_filters_change_no_result(spark, folder):
    path, points = folder
    df = binary.read_las(spark, path, columns=["scan_id", "X", "Z"]).where("X > 20.25 and X <= 20.75 and Z < 0.5")
    assert df.columns == ["scan_id", "X", "Z"]
    got = df.collect()
    x = points.X.round(3)
    assert len(got) == int(((x > 20.25) & (x <= 20.75) & (points.Z.round(3) < 0.5)).sum()) and {r.scan_id for r in got} == {"s2.las"}
    assert binary.read_las(spark, path, fill_intensity=False).where("X = 1000").count() == 0
    assert binary.read_las(spark, path, fill_intensity=False).count() == 4000
