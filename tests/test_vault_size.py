"""Commands on a vault: what they fetch to the driver, or send from it, doesn't grow with the notes they change."""

from contextlib import contextmanager

import pytest
from pyspark.sql import DataFrame, SparkSession

from linkloom.sources.vault import Vault

N, MOST = 40, 20


@pytest.fixture
def vault(spark, tmp_path):
    for i in range(N):
        (tmp_path / f"n{i:02}.md").write_text("[t](d/T.md#h)\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/T.md").write_text("")
    return Vault(spark, str(tmp_path))


@contextmanager
def little():
    """Fails where more than MOST rows come to the driver or go from it at once."""
    create = SparkSession.createDataFrame
    olds = {k: k.collect for k in (DataFrame, *DataFrame.__subclasses__())}

    def collected(self):
        rows = olds[type(self)](self)
        assert len(rows) <= MOST
        return rows

    def created(self, data, *a, **k):
        assert not isinstance(data, list) or len(data) <= MOST
        return create(self, data, *a, **k)

    for k in olds:
        k.collect = collected
    SparkSession.createDataFrame = created
    try:
        yield
    finally:
        for k, old in olds.items():
            k.collect = old
        SparkSession.createDataFrame = create


def test_move(vault, tmp_path):
    vault.build()
    with little():
        out = vault.move("d", "e")["rewritten"]
    assert {(tmp_path / f"n{i:02}.md").read_text() for i in range(N)} == {"[t](e/T.md#h)\n"}
    assert out == [{"file": f"n{i:02}.md", "old": "[t](d/T.md#h)", "new": "[t](e/T.md#h)"} for i in range(N)]


def test_simplify(vault, tmp_path):
    with little():
        vault.simplify()
    assert {(tmp_path / f"n{i:02}.md").read_text() for i in range(N)} == {"[t](T.md#h)\n"}


def test_convert(vault, tmp_path):
    with little():
        vault.convert("wikilink")
    assert {(tmp_path / f"n{i:02}.md").read_text() for i in range(N)} == {"[[d/T#h|t]]\n"}
