"""Result equality of executed statements: positions, NULLs, number types, order, errors."""

from fiscus.operators.execution import evaluate_pairs


def test_equality_rules(spark):
    pairs = [
        ("NULL place counts", "SELECT 1, NULL", "SELECT NULL, 1", False),
        ("int equals bigint", "SELECT CAST(1 AS INT)", "SELECT CAST(1 AS BIGINT)", True),
        ("int equals double", "SELECT 1", "SELECT 1.0D", True),
        ("names do not count", "SELECT 1 AS a", "SELECT 1 AS b", True),
        ("order counts", "SELECT id FROM range(5000) ORDER BY id", "SELECT id FROM range(5000) ORDER BY id DESC", False),
        ("same order", "SELECT id FROM range(5000) ORDER BY id DESC", "SELECT 4999 - id FROM range(5000) ORDER BY id", True),
        ("more rows", "SELECT 1", "SELECT explode(array(1, 1))", False),
        ("no rows", "SELECT 1 WHERE false", "SELECT 'a' WHERE false", True),
        ("rows against none", "SELECT 1", "SELECT 1 WHERE false", False),
        ("unknown column", "SELECT 1", "SELECT no_such_column", False),
        ("fails while running", "SELECT 1", "SELECT raise_error('x')", False),
        ("gold fails", "SELECT no_such_column", "SELECT 1", False),
        ("both fail", "SELECT no_such_column", "SELECT no_such_column", False)]
    got = {r.id: r for r in evaluate_pairs(spark, [(i, "d", "c", p[1], p[2]) for i, p in enumerate(pairs)]).collect()}
    assert {p[0]: got[i].is_correct for i, p in enumerate(pairs)} == {p[0]: p[3] for p in pairs}
    assert got[9].execution_error and not got[9].execution_success and got[9].pred_rows is None
    assert got[10].execution_error
    assert (got[8].pred_rows, got[8].gold_rows) == (0, 1)
    assert got[11].execution_success and got[11].gold_rows is None
