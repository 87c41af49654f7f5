"""A file that comes late with an old modification time is taken like any other."""

from __future__ import annotations

import os
import time

from pagelake.operators import store
from pagelake.streaming.ingest import ingest


def test_late_files_are_taken(spark, tmp_path):
    folder, silver, checkpoint = tmp_path / "in", f"file://{tmp_path}/silver", f"file://{tmp_path}/checkpoint"
    folder.mkdir()
    for name, days in (("new", 0), ("newer", -1), ("two_days", 2), ("ten_days", 10), ("a_year", 365)):
        file = folder / f"{name}.txt"
        file.write_text(name)
        at = time.time() - days * 86_400
        os.utime(file, (at, at))
        ingest(spark, f"file://{folder}", silver, checkpoint).awaitTermination(60)
    assert sorted(r.filename for r in store.read_table(spark, silver).collect()) == ["a_year.txt", "new.txt", "newer.txt", "ten_days.txt", "two_days.txt"]
