"""The run configuration: YAML to frozen dataclasses, with checks."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from lacuna.operators.prep import ABLATIONS, Ablation


@dataclass(frozen=True)
class Encoder:
    id: str
    name: str
    family: str
    hidden_size: int


@dataclass(frozen=True)
class Config:
    encoders: tuple[Encoder, ...] = (Encoder("hashing", "hashing", "hashing", 384),)
    ablations: tuple[Ablation, ...] = ABLATIONS

    def __post_init__(self) -> None:
        for kind, entries in (("encoders", self.encoders), ("ablations", self.ablations)):
            ids = [e.id for e in entries]
            if not ids:
                raise ValueError(f"no {kind} in the configuration")
            if len(set(ids)) < len(ids):
                raise ValueError(f"repeated ids among the {kind}: {ids}")

    def selected(self, encoders: list[str] | None = None, ablations: list[str] | None = None) -> list[tuple[Encoder, Ablation]]:
        """The pairs to run; unknown ids and an empty choice are errors."""
        out = []
        for kind, entries, wanted in (("encoder", self.encoders, encoders), ("ablation", self.ablations, ablations)):
            known = {e.id: e for e in entries}
            if unknown := [x for x in wanted or [] if x not in known]:
                raise ValueError(f"unknown {kind} {unknown}; known: {list(known)}")
            chosen = [known[x] for x in (known if wanted is None else wanted)]
            if not chosen:
                raise ValueError(f"no {kind} chosen")
            out.append(chosen)
        return [(e, a) for e in out[0] for a in out[1]]


def load_config(path: str | Path) -> Config:
    """Read ``encoders`` and ``ablations`` from a YAML file; other sections are left to their readers."""
    import yaml

    spec = yaml.safe_load(Path(path).read_text()) or {}
    fields = ("id", "name", "family", "hidden_size")
    encoders = tuple(Encoder(**{k: e[k] for k in fields}) for e in spec.get("encoders") or [])
    ablations = tuple(Ablation(a["id"], a.get("header", "preserve"), a.get("target", "mask"), bool(a.get("co_missing_drop", False))) for a in spec.get("ablations") or [])
    return Config(encoders, ablations)
