"""Contracts for what needs an external toolchain: schema in, schema out, NULL where it fails.

No chemistry is imitated. A backend is any callable on one row; without one, using an operator raises at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from shapelake.operators.evaluation import UNCONDITIONAL, evaluate

CONTRACTS = {
    "embed": ("smiles string", "i long, smiles string, molblock string, error string"),
    "ensemble": ("smiles string", "i long, smiles string, conf int, molblock string, energy double, error string"),
    "xtb_single_point": ("molblock string", "i long, energy double, charges array<double>, error string"),
    "xtb_optimise": ("molblock string", "i long, molblock string, energy double, charges array<double>, error string"),
    "pharmacophores": ("molblock string", "i long, ptypes array<int>, anchors array<array<double>>, vectors array<array<double>>, atom_ids array<array<int>>, error string"),
    "mesh_surface": ("molblock string, n int", "i long, positions array<array<double>>, error string"),
    "unconditional": ("atoms array<int>, positions array<array<double>>", UNCONDITIONAL),
    "dock": ("smiles string", "i long, smiles string, energy double, pose string, error string"),
    "relax": ("molblock string", "i long, energy double, pose string, error string"),
    "interactions": ("molblock string", "i long, residues array<string>, types array<string>, counts array<int>, error string"),
    "protonate": ("smiles string, ph double", "i long, smiles string, protomers array<string>, error string"),
    "neutralise": ("smiles string", "i long, smiles string, error string"),
    "crippen_align": ("ref string, fit string", "i long, molblock string, score double, error string"),
}


class BackendNotInstalled(RuntimeError):
    pass


_backends: dict[str, Callable[[dict], dict]] = {}


def register(name: str, backend: Callable[[dict], dict]) -> None:
    """Backends run on executors, a row (a dict) at a time, within Arrow batches."""
    if name not in CONTRACTS:
        raise ValueError(f"unknown contract {name!r}; known: {', '.join(CONTRACTS)}")
    _backends[name] = backend


def unregister(name: str) -> None:
    _backends.pop(name, None)


def apply(name: str, rows: DataFrame) -> DataFrame:
    """One result per input row (numbered ``i``); a failure is a row with NULLs and its error."""
    if name not in CONTRACTS:
        raise ValueError(f"unknown contract {name!r}; known: {', '.join(CONTRACTS)}")
    if name not in _backends:
        raise BackendNotInstalled(f"no backend for {name!r} is installed; register one with register({name!r}, ...)")
    return evaluate(rows, _backends[name], CONTRACTS[name][1])
