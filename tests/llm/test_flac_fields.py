"""Bit fields of FLAC frames against a plain string of bits."""

import random

import numpy as np

from symweave.llm import flac


def test_fields_stand_where_they_should():
    rng, bits, fields = random.Random(2), "", []
    for _ in range(500):
        bits += "0" * rng.randrange(70)
        width = rng.randrange(1, 33)
        value = rng.choice([rng.randrange(1 << width), (1 << width) - 1])
        fields.append((len(bits), width, value))
        bits += f"{value:0{width}b}"
    bits += "0" * (-len(bits) % 8)
    want = int(bits, 2).to_bytes(len(bits) // 8)
    at, width, value = map(np.array, zip(*fields))
    assert flac._packed(len(want), [(at, width, value)]).tobytes() == want
    assert flac._packed(len(want), [(at[k : k + 1], int(width[k]), value[k : k + 1]) for k in range(500)]).tobytes() == want
    assert flac._packed(3, []).tobytes() == bytes(3)


def test_streams_do_not_depend_on_the_run():
    rng = np.random.default_rng(4)
    payload = np.concatenate([rng.integers(97, 123, 192 * 700), np.full(192, 32), rng.integers(0, 256, 192 * 30)]).astype(np.uint8)
    (stream,) = flac.encode(payload, np.array([len(payload)]))
    samples = (payload ^ np.uint8(128)).view(np.int8).reshape(-1, flac.BLOCK)
    assert stream.endswith(flac.encode_frames(samples, np.arange(len(samples)))[0].tobytes())
    assert flac.decode([stream])[0].tobytes() == payload.tobytes()
