"""Continued training of a masked language model by a program outside the engine, on the text that the engine has written."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass


@dataclass(frozen=True)
class Training:
    """Settings of a run; the text is that of ``sinks.training_text``."""

    epochs: int = 5
    batch: int = 32
    length: int = 256
    mask: float = 0.15
    seed: int = 42

    def arguments(self, text: str, model: str, out: str) -> list[str]:
        """What the program is called with: one option a setting, and the folders of the two parts of the text."""
        given = {"model": model, "train": f"{text}/train", "validation": f"{text}/val", "out": out, "epochs": self.epochs, "batch-size": self.batch, "max-length": self.length, "mask-probability": self.mask, "seed": self.seed}
        return [x for k, v in given.items() for x in (f"--{k}", str(v))]

    def run(self, program: list[str], text: str, model: str, out: str) -> None:
        """Run the program to its end; an error of it raises."""
        subprocess.run([*program, *self.arguments(text, model, out)], check=True)
