"""When someone speaks in a clip: frames that a word touches, and frames louder than the clip's quiet ones."""

from __future__ import annotations

import itertools

import numpy as np

from .scoring import quantile_of


def frame_levels(samples: np.ndarray, hop: int, most: int) -> np.ndarray:
    """rms of each hop samples, for at most `most` frames; a last hop that isn't full has none."""
    n = min(most, len(samples) // hop)
    own = samples[: n * hop].reshape(n, hop).astype(float)
    return np.sqrt(np.einsum("ij,ij->i", own, own) / hop + 1e-9)


def word_frames(clip: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray, fps: int) -> np.ndarray:
    """Frames from that in which a word (ms from its clip's start) begins to the one after it ends; words outside their clip's n frames touch none. A clip's frames follow the last one's, with one more that is never touched."""
    edges = np.append(0, np.cumsum(n + 1))
    first = np.maximum(0, start * fps // 1000)
    last = np.minimum(n[clip], -(-end * fps // 1000) + 1)
    there = first < last
    turns = lambda x: np.bincount(edges[clip[there]] + x[there], minlength=edges[-1])
    return np.cumsum(turns(first) - turns(last)) > 0


def speech_masks(clip: np.ndarray, start: np.ndarray, end: np.ndarray, levels: np.ndarray, n_levels: np.ndarray, n: np.ndarray, fps: int) -> np.ndarray:
    """speech_mask of many clips at once, laid out as word_frames are: words with their clips' numbers, and the levels of the first n_levels (n at most) of the n frames of each clip."""
    mask = word_frames(clip, start, end, n, fps)
    edges = np.append(0, np.cumsum(n_levels))
    floor = np.array([max(0.01, quantile_of(levels[a:z], 0.25) * 1.8) if z > a else 0.0 for a, z in itertools.pairwise(edges.tolist())])
    loud = np.flatnonzero(levels > np.repeat(floor, n_levels))
    mask[np.repeat(np.cumsum(n + 1) - n - 1 - edges[:-1], n_levels)[loud] + loud] = True
    return mask


def speech_mask(start: np.ndarray, end: np.ndarray, samples: np.ndarray, n: int, fps: int, rate: int) -> np.ndarray:
    """Whether someone speaks in each of n frames: a word touches it, or its level is over 1.8 times the first quartile of all (0.01 at least). Without samples the words decide."""
    levels = frame_levels(samples, max(1, rate // fps), n)
    return speech_masks(np.zeros(len(start), np.int64), start, end, levels, np.array([len(levels)]), np.array([n]), fps)[:n]
