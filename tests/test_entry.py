import os
import subprocess
import sys

import pytest


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["ahocorasick", "xxhash", "palaver.llm.registry", "palaver.llm", "corpus_pipeline"])
def test_entry_point_without_the_training_data_part(missing):
    """With a library or the whole part missing, the other queries are there."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1_') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    n, operators, pipeline, twins = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(n) > 150 and twins == "True" and pipeline == "False" and (operators == "False" or missing == "corpus_pipeline")


def test_command_line(spark, tmp_path, capsys):
    from palaver.__main__ import main

    main(["list"])
    assert "prf_word" in capsys.readouterr().out.split()
    main(["run", "prf_word", "/root/testdata/sf0.001", str(tmp_path / "prf")])
    assert spark.read.parquet(str(tmp_path / "prf")).count() == 11
    rows = "Speaker: 1A\n\n" + "\n".join(f"(1:1:{i})\t{i}.0\t{i}.5\tw{i}\tNN\t{t}" for i, t in enumerate(["<f/><tc/>", '<rms id="2"/><cc/>', '<rps id="2"/><rpnsub id="2"/><ct/>'])) + "\n"
    for name, text in (("gold", rows), ("hyp", rows.replace('<rms id="2"/>', "<e/>"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.text").write_text(text)
    main(["evaluate", str(tmp_path / "gold"), str(tmp_path / "hyp"), str(tmp_path / "scores")])
    scores = {(r["metric"], r["tag"]): r["value"] for r in spark.read.csv(str(tmp_path / "scores"), header=True).collect()}
    assert float(scores["word_f1", "<rps"]) == 1.0 and float(scores["word_recall", "<rms"]) == 0.0
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "a", "b"])
