import json

import pytest


@pytest.fixture(scope="session")
def tiny_vocabulary(tmp_path_factory):
    """A small byte-level BPE file in the tokenizers library's format, built by a rule."""
    from corpuspulse.llm.bpe import byte_symbols
    symbol = {b: c for c, b in byte_symbols().items()}
    word = lambda s: "".join(symbol[b] for b in s.encode())
    vocab = {symbol[b]: b for b in range(256)}
    merges = []
    for a, b in [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "a"), (" ", "a"), ("ab", "ab"), (" a", "b"), ("b", "b"), ("aa", "b"), ("é", "e")]:
        left, right = word(a), word(b)
        for x in (left, right):
            parts = [c for c in x]
            while len(parts) > 1 and x not in vocab:
                merges.append((parts[0], parts[1]))
                vocab[parts[0] + parts[1]] = len(vocab)
                parts = [parts[0] + parts[1], *parts[2:]]
        merges.append((left, right))
        vocab[left + right] = len(vocab)
    special = {"id": len(vocab), "content": "<|end|>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [special], "normalizer": None,
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
            "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
            "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                      "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]}}
    path = tmp_path_factory.mktemp("vocabulary") / "tiny.json"
    path.write_text(json.dumps(spec))
    return str(path)
