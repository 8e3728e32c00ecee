"""Synthetic recordings for the state machines."""

import numpy as np

from lineweave.functions.pixels import pack_mask
from lineweave.streaming.frames import Frame, Seen

H, W, FPS = 8, 64, 10.0
BOX = (0, 0, W, H)


def glyphs(seed):
    return np.random.default_rng(seed).random((H, W)) < 0.06


def frame(index, mask=None, text=None, confidence=0.9, others=(), signature=None):
    mask = np.zeros((H, W), dtype=bool) if mask is None else mask
    attempts = [Seen(text, confidence, BOX, "m") if text is not None else None]
    attempts += [Seen(t, c, BOX, "alt") for t, c in others]
    packed = None if signature is None else pack_mask(signature)
    return Frame(index, index / FPS, H, W, pack_mask(mask), attempts if text is not None or others else [None], packed)


def play(machine, total, shows):
    """``shows``: (first, end, mask seed, text, extra keyword arguments) for what is on screen."""
    for i in range(total):
        on = next((s for s in shows if s[0] <= i < s[1]), None)
        machine.feed(frame(i, glyphs(on[2]), on[3], **(on[4] if len(on) > 4 else {})) if on else frame(i))
    return machine.close()
