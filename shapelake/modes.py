"""The alignment modes: what each needs, and its defaults. One registry for scoring, alignment and screening."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Mode:
    name: str
    columns: tuple[str, ...]
    score: str
    seeds: int
    steps: int
    required: tuple[str, ...] = ()


MODES = {
    m.name: m
    for m in (
        Mode("vol", ("atoms",), "sim_aligned_vol_noH", 10, 30),
        Mode("vol_esp", ("atoms", "charges"), "sim_aligned_vol_esp_noH", 16, 50, ("lam",)),
        Mode("surf", ("surface",), "sim_aligned_surf", 8, 40),
        Mode("surf_esp", ("surface", "esp"), "sim_aligned_surf_esp", 8, 40),
        Mode("vol_and_surf_esp", ("atoms", "surface", "esp", "atoms_with_h", "charges_with_h", "radii"), "sim_aligned_vol_and_surf_esp", 8, 60, ("alpha",)),
        Mode("pharm", ("pharm",), "sim_aligned_pharm", 32, 50),
        Mode("vol_color", ("atoms", "pharm"), "sim_aligned_vol_color", 16, 40),
    )
}
ALIASES = {"esp": "surf_esp", "esp_combo": "vol_and_surf_esp"}


def canonical(name: str) -> str:
    """An older name's present one; unknown names pass through."""
    return ALIASES.get(name, name)


def mode(name: str) -> Mode:
    found = MODES.get(canonical(name))
    if found is None:
        raise ValueError(f"unknown mode {name!r}; known: {', '.join(MODES)}")
    return found


def columns_for(names: list[str]) -> set[str]:
    """Columns that a store for these modes holds."""
    return {c for n in names for c in mode(n).columns}


def supports(stored: set[str], name: str) -> bool:
    return set(mode(name).columns) <= stored


def resolve(name: str, alpha: float | None = None, lam: float | None = None) -> Mode:
    """The mode, once what it cannot do without is given."""
    found = mode(name)
    for need in found.required:
        if {"alpha": alpha, "lam": lam}[need] is None:
            raise ValueError(f"mode {found.name} needs {need}")
    return found
