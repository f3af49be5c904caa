"""The whole way on a small credit-default file: CSV -> silos -> rounds -> report."""

import numpy as np
import pytest

from siloml.operators.frame import CREDIT_CATEGORICALS, CREDIT_KBEST, clean_credit
from siloml.plans.prepare import prepare
from siloml.plans.rounds import result_of, run_rounds
from siloml.sources.tables import CREDIT_LABEL, credit_schema, scan_table
from siloml.spec import LogisticSpec, PrepareSpec, RoundSpec


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    names = credit_schema().names
    lines = [",".join(names)]
    for i in range(600):
        late = rng.integers(-1, 4, 6)
        row = {n: 0 for n in names}
        row |= {"ID": i + 1, "LIMIT_BAL": 1000.0 * rng.integers(1, 50), "SEX": 1 + i % 2, "EDUCATION": 1 + i % 4,
                "MARRIAGE": 1 + i % 3, "AGE": 20 + i % 40, CREDIT_LABEL: int(late.sum() + rng.normal() > 8)}
        row |= dict(zip(("PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"), map(int, late)))
        row |= {f"BILL_AMT{m}": float(rng.integers(0, 9000)) for m in range(1, 7)}
        row |= {f"PAY_AMT{m}": float(rng.integers(0, 900)) for m in range(1, 7)}
        lines.append(",".join(str(row[n]) for n in names))
    path = tmp_path_factory.mktemp("credit") / "credit.csv"
    path.write_text("\n".join(lines) + "\n")
    return clean_credit(scan_table(spark, str(path), "csv", credit_schema()))


def spec(**options):
    return PrepareSpec(n_silos=3, min_silo_size=50, categoricals=CREDIT_CATEGORICALS, **options)


def test_rounds_on_credit_rows(table):
    prepared = prepare(table, spec())
    assert prepared.width == 29 and prepared.df.count() == 600  # 20 numeric + 2 + 4 + 3 levels
    _, history, _ = run_rounds(prepared, LogisticSpec(C=1.0), RoundSpec(rounds=1, merge="FedF1"))
    result = {(r["class"], r["metric"]): r["value"] for r in result_of(history, "logistic").collect()}
    assert result["", "test_accuracy"] > 0.8


def test_smote_selection_and_pca(table):
    chosen = prepare(table, spec(smote=True, kbest=CREDIT_KBEST))
    assert chosen.names == CREDIT_KBEST
    sizes = {(r["client_id"], r["label"]): r["count"] for r in
             chosen.df.where("split = 'train'").groupBy("client_id", "label").count().collect()}
    assert all(sizes[c, 0] == sizes[c, 1] for c in range(3))
    reduced = prepare(table, spec(undersample=True, pca=4))
    assert reduced.width == 4 and len(reduced.df.first()["features"]) == 4
    with pytest.raises(ValueError, match="choose one"):
        prepare(table, spec(pca=2, kbest=CREDIT_KBEST))
