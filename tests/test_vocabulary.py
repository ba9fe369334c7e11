"""The cue vocabulary on phrases of our own."""

import pytest

from tidemark.functions import vocabulary as V

MOVED = {
    "brow_raise": ["both eyebrows lifted high", "arching one brow"],
    "brow_furrow": ["she frowns a little", "forehead wrinkled at the end", "brows are knitted"],
    "head_shake": ["shaking of the head", "her head is swaying", "a clear headshake"],
    "head_nod": ["nods at once", "the chin dips"],
    "head_tilt": ["tilting to one shoulder", "head slightly cocked"],
    "mouth_shape": ["lips pressed", "jaw drops", "a pout"],
    "smile": ["a broad grin", "smiling throughout"],
    "eye_widen": ["widened eyes", "eyes are stretched open"],
    "blink_close": ["one long blink", "eyelids squeezed together", "eyes shut"],
    "gaze_shift": ["glances at the hands", "looks far away", "keeps eye contact"],
    "sign_size": ["very small signs", "the movements become large"],
    "speed_fast": ["brisk signing", "hurried at the end"],
    "speed_slow": ["slowly", "a leisurely account"],
    "repetition": ["the sign is repeated", "made twice"],
    "emphasis": ["stressed the last sign", "with exaggerated force"],
    "fingerspelling": ["hand spelling of a town", "spells the whole name"],
    "pause_hesitation": ["halting", "lingers before the answer"],
    "body_posture": ["an upright stance", "body bent forward", "shoulders drop"],
}
READ = ["conveys a feeling of doubt", "it seems to suggest anger", "an impression of calm", "full of joy and surprise"]


@pytest.fixture(scope="module")
def found(spark):
    texts = [t for v in MOVED.values() for t in v] + READ + ["", None, "nothing of the kind", "NODDING", "noddéd", "anodyne", "renod"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.movements("t").alias("m"), V.readings("t").alias("r")).collect()
    return {r["t"]: (r["m"], r["r"]) for r in rows}


def test_every_cue_is_found_with_its_span(found):
    assert set(MOVED) == set(V.MOVEMENTS)
    for cue, texts in MOVED.items():
        for t in texts:
            assert cue in found[t][0] and found[t][0][cue] in t, (cue, t, found[t])


def test_readings_are_no_movements(found):
    for t in READ:
        assert found[t][0] == {} and found[t][1], (t, found[t])


def test_words_begin_with_a_stem(found):
    assert found["NODDING"][0]["head_nod"] == "NODDING" and found["noddéd"][0]["head_nod"] == "noddéd"
    assert found["anodyne"] == ({}, []) and found["renod"] == ({}, []) and found["nothing of the kind"] == ({}, [])
    assert found[""] == ({}, [])


def test_fast_and_slow_share_a_feature():
    assert V.MOVEMENTS["speed_fast"][1] == V.MOVEMENTS["speed_slow"][1]
