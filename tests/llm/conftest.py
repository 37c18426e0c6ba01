import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A DataFrame of texts, with ids from 0 or as given."""

    def make(texts, ids=None, extra=()):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t), *[None for _ in extra]) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in extra))

    return make


#: Nulls, blanks, ties, repeats, markup, other scripts and a very long text.
ODD = [None, "", " ", "\n\t", "a", "a", "!!!", "!!!", "???", None, "é è ü", "你好 世界", "😀😀", "x" * 300_000, "word " * 60_000, "a b c d e f g h", "A B C D E F G H", "\x00 nul", "a" * 70 + " b", "0"]
CLASH = ("keep", "score", "group_id", "size", "prefix", "fp", "node", "shard", "n_tokens", "bucket", "gone_id", "row_rank", "label", "toxic", "ids")
