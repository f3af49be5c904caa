"""Column contract and options. Options are plain dataclasses; there is no config reader."""

from __future__ import annotations

from dataclasses import dataclass

ROW_ID = "row_id"
CLIENT = "client_id"
SPLIT = "split"
LABEL = "label"
FEATURES = "features"
TRAIN, TEST, VAL = "train", "test", "val"
CONTRACT = (ROW_ID, CLIENT, SPLIT, LABEL)


def silo_type(df) -> str:
    """SQL type of the silo ids, any integer type; kernels hand it on."""
    return df.schema[CLIENT].dataType.simpleString()


@dataclass(frozen=True)
class PrepareSpec:
    """Options of one silo preparation (scan -> silos -> split -> transforms)."""

    seed: int = 42
    n_silos: int = 5
    alpha: float = 10.0
    min_silo_size: int = 1000
    by_column: str | None = None  # natural silo key instead of the Dirichlet draw
    categoricals: tuple[str, ...] = ()
    encode: bool = True
    scale: bool = True
    smote: bool = False
    undersample: bool = False
    pca: int = 0
    kbest: tuple[str, ...] = ()
    refuse_bad: bool = True  # raise on null or non-finite features; otherwise their silos' fits fail

    def __post_init__(self):
        validate_options(self.smote, self.undersample, self.pca)


def validate_options(smote: bool, undersample: bool, pca: int) -> None:
    if smote and undersample:
        raise ValueError("choose either SMOTE or random undersampling, not both")
    if pca == 1 or pca < 0:
        raise ValueError("PCA needs at least 2 components (0 switches it off)")


@dataclass(frozen=True)
class LogisticSpec:
    """L1 logistic regression: C * sum(w_i * loss_i) + |w|_1, intercept penalised like any weight."""

    C: float = 0.01
    balanced: bool = False
    penalise_intercept: bool = True
    max_iter: int = 50
    tol: float = 1e-6
    family: str = "logistic"


@dataclass(frozen=True)
class SvcSpec:
    """Squared-hinge linear SVM: C * sum(w_i * max(0, 1 - y m)^2) + |w|^2 / 2."""

    C: float = 10.0
    balanced: bool = True
    penalise_intercept: bool = True
    max_iter: int = 50
    tol: float = 1e-6
    family: str = "squared_hinge"


@dataclass(frozen=True)
class GradientSpec:
    """Logistic regression by full-batch gradient steps of size ``lr``, without a penalty."""

    lr: float = 0.1
    family: str = "gradient"


@dataclass(frozen=True)
class MlpSpec:
    hidden: int = 100
    max_iter: int = 1000
    tol: float = 1e-4
    alpha: float = 1e-4
    seed: int = 42
    family: str = "mlp"


@dataclass(frozen=True)
class ForestSpec:
    n_trees: int = 100
    max_depth: int = 10
    min_samples_split: int = 5
    min_samples_leaf: int = 1
    max_bins: int = 256
    seed: int = 42
    balanced: bool = False
    family: str = "forest"


@dataclass(frozen=True)
class BoostSpec:
    """Second-order boosting on logistic loss over quantile bins."""

    n_local_trees: int = 10
    eta: float = 0.1
    max_depth: int = 3
    max_bins: int = 256
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    base_margin: float = 0.0
    family: str = "boost"


@dataclass(frozen=True)
class RoundSpec:
    """One silo experiment.

    one_shot      fit once from scratch and reuse the fit in each round (what estimators without warm
                  start do); otherwise each round starts at the merged parameters and takes
                  ``local_steps`` Newton steps.
    trees_per_client / scale_first
                  how many new trees a later silo adds to the shared ensemble, and whether the first
                  silo's trees are weighted too. None / True are the sound choices, 1 / False the
                  compatible ones.
    weight_trees  let the merge weight scale a tree's contribution when scoring (False: stored only).
    """

    rounds: int = 10
    merge: str = "FedAvg"
    one_shot: bool = True
    local_steps: int = 3
    min_clients: int = 2
    accept_failures: bool = True
    trees_per_client: int | None = 1
    scale_first: bool = False
    weight_trees: bool = False
    report_split: str = TEST
