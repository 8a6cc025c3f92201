"""Trains the tagger of ``pii`` from labelled spans and writes its weights.

``python -m gridloom.llm.train_tagger``: some minutes of one core, always with
the same result on one machine.
"""

from __future__ import annotations

import numpy as np

from .pii import WEIGHTS, Tagger, labelled

TEXTS, EPOCHS = 3_000, 10


def main() -> None:
    model = Tagger()
    for loss in model.train(*labelled(TEXTS, 1), epochs=EPOCHS):
        print(f"{loss:.3f}")
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in model.p.items()})


if __name__ == "__main__":
    main()
