import pytest

#: Texts that every operator has to take: null, empty, white space, ties, repeats, odd characters.
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a b"), (6, "Same text, here."), (7, "Same text,  here."), (7, "Same text,  here."), (None, "no id"), (9, "é😀\x1c\x85 ß"), (10, "x" * 70_000), (11, "one two three " * 5000), (-(2**63), "lowest id"), (12, "word " * 200_000)]
#: Names that operators use, or once used, inside.
CLASHES = ["_id", "_hash", "_kept", "_own", "_own_sha", "_own_len", "_won_id", "_nth", "_gone", "_spans", "_key", "_rows", "_salt", "_score", "_slot", "_crc", "shard", "slot", "size", "budget", "epochs", "copies", "label", "before", "component_id", "kept"]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with null, empty, repeated and very long texts and columns whose names operators use inside."""
    rows = [(i, t, None if k % 3 else "en", f"src{k % 2}" if k % 4 else None, None, k, "x", k, *[f"{c}{k}" for c in CLASHES]) for k, (i, t) in enumerate(EDGE)]
    own = "".join(f", {c} string" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, row long, key string, n long{own}").repartition(3)


def columns_as_before(before, after):
    """Whether the rows of ``after`` have the values of ``CLASHES`` that they had in ``before``."""
    seen = {tuple(r) for r in before.select("doc_id", *CLASHES).collect()}
    return {tuple(r) for r in after.select("doc_id", *CLASHES).collect()} <= seen


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")
