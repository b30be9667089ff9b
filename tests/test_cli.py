import datetime as dt
import os

import pytest

from tessera import __main__ as cli, runlog
from tessera.sources import files


def test_generate_keeps_a_corpus_and_a_record(spark, tmp_path, capsys):
    small = ["--set", "events=300", "--set", "days=40", "--set", "query_days=4", "--set", "half_life_days=5.0"]
    assert cli.main(["generate", "--name", f"{tmp_path}/c", "--logs", f"{tmp_path}/logs", *small]) == 0
    c = files.load(spark, f"{tmp_path}/c")
    assert c.events.count() == 300 and c.queries.count() == 8
    (name,) = os.listdir(f"{tmp_path}/logs")
    text = (tmp_path / "logs" / name).read_text()
    assert "300 events, 8 queries" in text and "300 events, 8 queries" in capsys.readouterr().out and "brand-" not in text


def test_unknown_providers_are_refused(capsys):
    assert cli.main(["generate", "--provider", "nothing", "--name", "x"]) == 2
    assert "synthetic" in capsys.readouterr().err


def test_records_never_share_a_file(tmp_path):
    at = dt.datetime(2024, 3, 5, 7, 8, 9, tzinfo=dt.timezone.utc)
    names = []
    for _ in range(3):
        with runlog.open_new(str(tmp_path), at) as f:
            names.append(os.path.basename(f.name))
    stem = f"20240305T070809Z-{os.getpid()}"
    assert names == [f"{stem}.log", f"{stem}-1.log", f"{stem}-2.log"]
    with pytest.raises(ValueError), runlog.recording(str(tmp_path / "r")) as say:
        say("so far")
        raise ValueError("no more")
    (name,) = os.listdir(tmp_path / "r")
    text = (tmp_path / "r" / name).read_text()
    assert "so far" in text and "ValueError: no more" in text and "done" not in text
