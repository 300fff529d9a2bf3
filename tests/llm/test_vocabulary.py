"""The default vocabulary's counts are those of the library's unigram model over the same pieces; nothing is trained."""

import json
import math

import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from pricescope.llm import token_count


def test_counts_equal_the_library(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").collect()]
    vocabulary = token_count.load_vocabulary()
    assert math.isclose(sum(math.exp(s) for _, s in vocabulary), 1)
    reference = Tokenizer(models.Unigram(vocabulary, 0, True))
    reference.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_count.Counter(vocabulary)
    for t in [*texts, "", "a\nb\tc", "日本語テキスト 🙂🙂", "  a  b ", "information development question Device"]:
        assert counter.text(t) == len(reference.encode(t, add_special_tokens=False).ids), repr(t[:40])
    # Near the counts of the file's own tokenizer.
    own = sentencepiece.SentencePieceProcessor(model_file=token_count.VOCABULARY)
    assert sum(counter.text(t) for t in texts) == pytest.approx(sum(len(own.encode(t)) for t in texts), rel=0.03)


def test_control_and_byte_pieces_match_nothing():
    counter = token_count.Counter(token_count.load_vocabulary())
    assert counter.text("<s>") > 1 and counter.text("<0x41>") > 1 and counter.text("<unk>") > 1


def test_json_of_a_unigram_model(tmp_path):
    file = tmp_path / "tokenizer.json"
    file.write_text(json.dumps({"model": {"type": "Unigram", "unk_id": 0, "vocab": [["<unk>", 0.0], ["▁", -1.5], ["▁a", -1.0], ["b", -2.0], ["ab", -0.5]]}}))
    vocabulary = token_count.load_vocabulary(str(file))
    assert vocabulary[2] == ("▁a", -1.0) and token_count.Counter(vocabulary).text("ab") == 2
    file.write_text(json.dumps({"model": {"type": "BPE", "vocab": {}}}))
    with pytest.raises(ValueError, match="no unigram model"):
        token_count.load_vocabulary(str(file))
