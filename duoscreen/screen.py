"""Layout of a screen table.

A screen is one wide row per construct: ``gene1, gene2, guide1, guide2`` plus one numeric column per sequenced
sample. The number of sample columns is fixed by the table's schema, so everything that combines samples of
one construct (fold change, replicate mean, masks) is a row expression and needs no shuffle. Frames become
long (one row per construct and replicate) only where a statistic is grouped by replicate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

GENE1, GENE2, GUIDE1, GUIDE2 = "gene1", "gene2", "guide1", "guide2"
CONSTRUCT = [GENE1, GENE2, GUIDE1, GUIDE2]


@dataclass(frozen=True)
class Layout:
    """Which columns of a screen table hold which sample.

    samples: cell line -> its late replicate columns.
    t0:      cell line -> its early column or columns, or the same for all lines.
    pairing: with several early columns, ``paired`` compares late replicate i with early replicate i, and ``averaged``
             compares each late replicate with the mean of the cell line's early ones.
    mid:     late replicate column -> mid time point column of the same replicate (optional).
    control: token that stands for a control gene.
    """

    samples: dict[str, list[str]]
    t0: dict[str, str | list[str]] | str | list[str]
    control: str = "CTRL"
    mid: dict[str, str] = field(default_factory=dict)
    pairing: str = "paired"

    def __post_init__(self) -> None:
        if self.pairing not in ("paired", "averaged"):
            raise ValueError(f"pairing is paired or averaged, not {self.pairing}")
        for sample, cols in self.samples.items():
            n = len(self.early_of(sample))
            if self.pairing == "paired" and n not in (1, len(cols)):
                raise ValueError(f"{sample} has {len(cols)} late and {n} early replicates, which can't be paired")

    @classmethod
    def by_token(cls, columns: list[str], tokens: list[str], t0, control: str = "CTRL") -> "Layout":
        """Group late columns by the cell-line token that their name contains; early columns are left out."""
        early = {c for x in (t0.values() if isinstance(t0, dict) else [t0]) for c in ([x] if isinstance(x, str) else x)}
        return cls({t: [c for c in columns if t in c and c not in early] for t in tokens}, t0, control)

    @property
    def late(self) -> list[str]:
        return [c for cols in self.samples.values() for c in cols]

    @property
    def early(self) -> list[str]:
        return sorted({c for s in self.samples for c in self.early_of(s)})

    def early_of(self, sample: str) -> list[str]:
        own = self.t0[sample] if isinstance(self.t0, dict) else self.t0
        return [own] if isinstance(own, str) else list(own)

    def sample_of(self, column: str) -> str:
        return next(s for s, cols in self.samples.items() if column in cols)

    def early_for(self, column: str) -> list[str]:
        """The early columns that a late column is compared with."""
        sample = self.sample_of(column)
        early = self.early_of(sample)
        if len(early) == 1 or self.pairing == "averaged":
            return early
        return [early[self.samples[sample].index(column)]]
