"""What the registered searches and fits ask for; the fits themselves are replaced."""

import pytest

from wardflow.plans import model_catalog, training

SEARCHES = {
    "grid_search_results": "Logistic_Regression",
    "grid_search_rf": "Random_Forest_Classifier",
    "grid_search_gbt": "Gradient_Boosted_Trees",
    "grid_search_dt": "Decision_Tree",
}


@pytest.fixture
def asked(monkeypatch):
    """(family, grid, folds) of every search that is started."""
    found = []

    def search(train, name, grid, key, folds=5, **options):
        found.append((name, grid, folds))
        return None, None

    def select(train, validation, key, grids, folds=5, seed=42):
        for name, grid in grids.items():
            search(train, name, grid, key, folds)
        raise InterruptedError

    monkeypatch.setattr(model_catalog, "sets", lambda spark, folder: (None, None))
    monkeypatch.setattr(training, "grid_search", search)
    monkeypatch.setattr(training, "train_and_select", select)
    return found


@pytest.mark.parametrize("query", SEARCHES)
def test_a_search_runs_its_whole_grid(asked, query):
    model_catalog.QUERIES[query](None, None)
    assert asked == [(SEARCHES[query], training.FULL_GRIDS[SEARCHES[query]], 5)]


def test_selection_compares_all_families(asked):
    with pytest.raises(InterruptedError):
        model_catalog.QUERIES["model_selection"](None, None)
    assert {name for name, _, _ in asked} == set(training.ESTIMATORS)
    assert all(grid == training.FULL_GRIDS[name] and folds == 5 for name, grid, folds in asked)


def test_fixed_models_are_of_the_full_grids():
    for name in ("Random_Forest_Classifier", "Gradient_Boosted_Trees", "Decision_Tree"):
        assert all(v in training.FULL_GRIDS[name][p] for p, v in model_catalog.FIXED[name].items())
