"""Languages without spaces between words are learned too."""

import pyarrow as pa

from skein.llm import langid


def test_languages_without_spaces_are_told_apart():
    texts = {"th": "กขคงจฉ" * 12, "zh": "天地人山水火" * 12}
    model = langid.fit(list(texts.values()), list(texts), sorted({c for t in texts.values() for c in t}))
    langs, score, _ = model.predict(pa.array(list(texts.values()), pa.string()))
    assert langs == list(texts)
    assert min(score) > 0.99
