"""Template texts for the oracle SQL, written out here so that a wrong text in the engine shows.

Fixed values: names, system texts and layouts of the five templates.
"""

from __future__ import annotations

from types import SimpleNamespace


def _template(prefix, prompt, system, sep, llama2_layout=False):
    return SimpleNamespace(prefix=prefix, prompt=prompt, system=system, sep=sep, llama2_layout=llama2_layout, use_history=True)


ORACLE_TEMPLATES = {
    "default": _template(
        ["{{system}}"], ["Human: {{query}}\nAssistant: "],
        "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, "
        "and polite answers to the user's questions.", ["\n"]),
    "alpaca": _template(
        ["{{system}}"], ["### Instruction:\n{{query}}\n\n### Response:\n"],
        "Below is an instruction that describes a task. Write a response that appropriately completes the request.", ["\n\n"]),
    "chatglm2": _template(
        [{"token": "[gMASK]"}, {"token": "sop"}, "{{system}}"], ["[Round {{idx}}]\n\n问：{{query}}\n\n答："], "", ["\n\n"]),
    "llama2": _template(
        ["<<SYS>>\n{{system}}\n<</SYS>>\n\n"], ["[INST] {{query}} [/INST] "],
        "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  "
        "Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. "
        "Please ensure that your responses are socially unbiased and positive in nature.\n"
        "If a question does not make any sense, or is not factually coherent, explain why instead of answering something "
        "not correct. If you don't know the answer to a question, please don't share false information.", [], True),
    "llama2_zh": _template(
        ["<<SYS>>\n{{system}}\n<</SYS>>\n\n"], ["[INST] {{query}} [/INST] "],
        "You are a helpful assistant. 你是一个乐于助人的助手。", [], True),
}
