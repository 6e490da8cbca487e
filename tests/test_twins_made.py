"""Queries against their SQL twins on small tables that are made for it."""

import duckdb
import pytest

from evidentia import plans
from test_queries import plain


@pytest.fixture
def differs(spark, tmp_path):
    """differs(query, table=(schema, rows), ...): rows of the query that its twin has not, and the other way round."""

    def run(name, **tables):
        duck = duckdb.connect()
        for t, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"{t}.parquet"))
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = plans.queries()[name](spark, str(tmp_path))
        cols = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        want = sorted((tuple(plain(v) for v in r) for r in duck.execute(f"SELECT {', '.join(cols)} FROM ({plans.oracle_sql()[name]})").fetchall()), key=repr)
        assert got
        return [r for r in got if r not in want], [r for r in want if r not in got]

    return run


TURN = "conv_id long, turn long, role string, text string"


def talk(*texts):
    """Conversations 0, 8, 16, ... of a question and one of the texts."""
    return TURN, [r for k, t in enumerate(texts) for r in ((8 * k, 0, "user", "What?"), (8 * k, 1, "assistant", t))]


def test_answers_without_tokens(differs):
    assert differs("r11_r16_answer_rewards", conversations=talk("The the the ersh.\nHaes to.", "A the, the", "Ersh the haes.")) == ([], [])


def test_weighted_answers_without_tokens(differs):
    assert differs("r22_weighted_reward", conversations=talk("The the the ersh.\nHaes to.", "Ersh the haes.")) == ([], [])


def test_think_just_longer_than_the_mean_fact(differs):
    # Copies of 81 and 59 characters in facts whose means lie around the 140 + 46 characters of think.
    assert differs("r17_r21_unified_rewards", conversations=talk(*("\n".join(("one by one " + "a" * 70, "c" * n, "d" * 59)) for n in range(380, 440, 3)))) == ([], [])


def test_as_many_logs_as_rows_need(differs, tmp_path, monkeypatch):
    monkeypatch.setattr("evidentia.plans.data_queries.scratch", lambda spark, name: str(tmp_path / name))
    events = "event_id long, user_id long, event_type string, value double", [(k, k, "view", k / 7) for k in range(300)]
    assert differs("s12_rollouts", events=events) == ([], [])
    assert len(list((tmp_path / "rollouts").glob("part-*.json"))) == 1


@pytest.mark.parametrize("texts", [["A", "", None, "en", "y👩‍👩‍👧é", "Re. The."], ["", None], [None], []])
def test_registry_of_short_and_missing_texts(differs, texts):
    rows = [(k, t, "en" if k % 4 else None, "src", len(t or "")) for k, t in enumerate(texts * 2, 1)]
    assert differs("u2_adapter_registry", documents=("doc_id long, text string, lang string, source string, n_chars long", rows)) == ([], [])
