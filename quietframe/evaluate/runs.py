"""Runs of metrics over combinations of columns, kept in a JSON file that a later run takes up, with errors counted."""

from __future__ import annotations

import json
from itertools import combinations
from pathlib import Path

from quietframe.evaluate.metrics import COMPARED, MULTI_COLUMN, SINGLE_COLUMN, Dataset, Metric


class _Run:
    def __init__(self, workload: list[dict] | None, metrics: dict[str, dict] | None, run_len: int, max_errors: int, output_path: str | None):
        self.workload, self.metrics, self.run_len, self.max_errors = workload or [{}], metrics or {}, run_len, max_errors
        self.path = Path(output_path) if output_path else None
        self.results: list[dict] = json.loads(self.path.read_text()) if self.path and self.path.exists() else []
        self.errors: list[dict] = []

    def wanted(self, known: dict, datasets: list[Dataset]) -> list[Metric]:
        raise NotImplementedError

    def one(self, metric: Metric, *datasets: Dataset) -> None:
        key = json.dumps([metric.serialize(), [d.idx for d in datasets]], sort_keys=True)
        if any(r["key"] == key for r in self.results) or len(self.errors) > self.max_errors:
            return
        try:
            self.results.append(metric.compute(*datasets) | {"key": key, "datasets": [d.idx for d in datasets]})
        except Exception as e:  # a metric that doesn't fit the data is a result of the run
            self.errors.append(metric.serialize() | {"error": str(e)[:500]})
        if self.path:
            self.path.write_text(json.dumps(self.results, default=str))

    def to_csv(self, path: str) -> None:
        """One line for each metric and parameters."""
        import csv

        with open(path, "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(["metric", "parameters", "datasets", "value"])
            for r in self.results:
                w.writerow([r["name"], json.dumps(r["parameters"]), json.dumps(r["datasets"]), json.dumps(r["value"], default=str)])


class Analyze(_Run):
    """Metrics of one dataset."""

    def __init__(self, dataset: Dataset, *, workload=None, metrics=None, run_len: int = 2, max_errors: int = 100, output_path: str | None = None):
        super().__init__(workload, metrics, run_len, max_errors, output_path)
        self.dataset = dataset

    def run(self) -> list[dict]:
        d = self.dataset
        for w in self.workload:
            chosen = [w["metric"]] if "metric" in w else list(self.metrics) or [*SINGLE_COLUMN, *MULTI_COLUMN]
            columns = w.get("columns", d.categorical_columns)
            for name in chosen:
                extra = self.metrics.get(name, {}) | w.get("parameters", {})
                if name in SINGLE_COLUMN:
                    kinds = d.categorical_columns if name in ("Cardinality", "Entropy") else [*d.measure_columns, *d.sum_columns]
                    for c in w.get("columns", kinds):
                        self.one(Metric.create(name, column=c, **extra), d)
                elif name in MULTI_COLUMN:
                    for n in range(1, self.run_len + 1):
                        for some in combinations(columns, n):
                            self.one(Metric.create(name, columns=list(some), **extra), d)
                else:  # asked for by name, with parameters of its own
                    self.one(Metric.create(name, **extra), d)
        return self.results


class Evaluate(_Run):
    """Metrics of an original against synthetic datasets."""

    def __init__(self, original: Dataset, synthetic: list[Dataset], *, workload=None, metrics=None, run_len: int = 2, max_errors: int = 100, output_path: str | None = None):
        super().__init__(workload, metrics, run_len, max_errors, output_path)
        self.original, self.synthetic = original, synthetic
        if not all(original.matches(s) for s in synthetic):
            raise ValueError("the datasets have different columns")

    def run(self) -> list[dict]:
        d = self.original
        for w in self.workload:
            for name in [w["metric"]] if "metric" in w else list(self.metrics) or list(COMPARED):
                extra = self.metrics.get(name, {}) | w.get("parameters", {})
                for n in range(1, self.run_len + 1):
                    for some in combinations(w.get("columns", d.categorical_columns), n):
                        measures = [*d.measure_columns, *d.sum_columns] if name in ("MeanAbsoluteError", "MeanProportionalError") else [None]
                        for m in measures:
                            for s in self.synthetic:
                                self.one(Metric.create(name, columns=list(some), **({"measure": m} if m else {}), **extra), d, s)
        return self.results
