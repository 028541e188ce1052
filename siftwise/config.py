"""Settings of the transfer pass. Session settings have the prefix ``siftwise.``."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

PREFIX = "siftwise."
CHOICES = {
    "filter_type": ("all", "bf_only", "minmax_only"),
    "pass_mode": ("both", "forward_only"),
    "heuristic": ("largest_root", "join_order"),
}


@dataclass(frozen=True)
class TransferConfig:
    """filter_type, pass_mode, heuristic: see CHOICES. flip_roots matters to join_order only.

    profiling and the two displays print text. gate leaves out filters that cannot pay: those built from a table
    that nothing has reduced, those for a table under min_probe_bytes, and those for a table smaller than the one that would be read for them. Bloom filters are not built from more than
    max_keys distinct keys, where they would no longer be small enough to send everywhere.
    """

    filter_type: str = "all"
    pass_mode: str = "both"
    heuristic: str = "largest_root"
    flip_roots: bool = True
    profiling: bool = False
    display_dag: bool = False
    display_physical_dag: bool = False
    gate: bool = True
    min_probe_bytes: int = 1 << 28
    max_keys: int = 32_000_000

    def __post_init__(self) -> None:
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}, not {getattr(self, name)!r}")

    def but(self, **changes) -> TransferConfig:
        return replace(self, **changes)

    @classmethod
    def of(cls, spark: SparkSession, **changes) -> TransferConfig:
        """The session's settings, with changes."""
        found: dict = {}
        for f in fields(cls):
            text = spark.conf.get(PREFIX + f.name, None)
            if text is None:
                continue
            default = f.default
            if isinstance(default, bool):
                if text.lower() not in ("true", "false"):
                    raise ValueError(f"{PREFIX}{f.name} is true or false, not {text!r}")
                found[f.name] = text.lower() == "true"
            else:
                found[f.name] = type(default)(text)
        return cls(**(found | changes))
