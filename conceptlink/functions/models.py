"""Hosted and local language models as batch callables; their packages are imported in the tasks only."""

from __future__ import annotations

import asyncio
from collections.abc import Callable

# Model names of the hosted services that components may ask for.
OPENAI_MODELS = ("gpt-5.2", "gpt-5", "gpt-5-nano", "gpt-5-mini")
QWEN_RERANKERS = ("Qwen/Qwen3-Reranker-0.6B", "Qwen/Qwen3-Reranker-4B", "Qwen/Qwen3-Reranker-8B")


def openai_chat(model: str) -> Callable[[], Callable[[list[dict]], str]]:
    def load() -> Callable[[list[dict]], str]:
        from openai import OpenAI

        client = OpenAI()
        return lambda messages: client.responses.create(model=model, input=messages).output_text

    return load


def gemini_chat(model: str) -> Callable[[], Callable[[list[dict]], str]]:
    def load() -> Callable[[list[dict]], str]:
        from google import genai

        client = genai.Client()
        return lambda messages: client.models.generate_content(model=model, contents=[m["content"] for m in messages]).text

    return load


def one_by_one(load: Callable[[], Callable[[list[dict]], str]]) -> Callable[[], Callable[[list[list[dict]]], list[str]]]:
    """A judge of batches from a model of single prompts."""

    def batched() -> Callable[[list[list[dict]]], list[str]]:
        ask = load()
        return lambda prompts: [ask(p) for p in prompts]

    return batched


def side_by_side(load: Callable[[], Callable[[list[dict]], str]], at_once: int = 16) -> Callable[[], Callable[[list[list[dict]]], list[str]]]:
    """The same with up to ``at_once`` prompts of a batch under way at a time."""

    def batched() -> Callable[[list[list[dict]]], list[str]]:
        ask = load()

        async def every(prompts: list[list[dict]]) -> list[str]:
            gate = asyncio.Semaphore(at_once)

            async def one(prompt: list[dict]) -> str:
                async with gate:
                    return await asyncio.to_thread(ask, prompt)

            return await asyncio.gather(*map(one, prompts))

        return lambda prompts: asyncio.run(every(prompts))

    return batched


def causal_yes_scorer(model: str, max_length: int = 8192) -> Callable[[], Callable[[list[str]], list[float]]]:
    """P(yes) of a local causal model for prompts of a pair; torch and transformers are needed."""

    def load() -> Callable[[list[str]], list[float]]:
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        from ..operators.rerank import fit_tokens, left_padded

        tokenizer = AutoTokenizer.from_pretrained(model)
        net = AutoModelForCausalLM.from_pretrained(model).eval()
        ids = lambda s: tokenizer(s, add_special_tokens=False)["input_ids"]
        before = ids("<|im_start|>system\nAnswer only with yes or no: does the document meet the query and the instruction?<|im_end|>\n<|im_start|>user\n")
        after = ids("<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n")
        no, yes = tokenizer.convert_tokens_to_ids("no"), tokenizer.convert_tokens_to_ids("yes")

        def score(prompts: list[str]) -> list[float]:
            rows = [fit_tokens(ids(p), before, after, max_length) for p in prompts]
            padded = torch.tensor(left_padded(rows, tokenizer.pad_token_id))
            with torch.no_grad():
                last = net(padded, attention_mask=(padded != tokenizer.pad_token_id).long()).logits[:, -1]
            return torch.softmax(last[:, [no, yes]], dim=1)[:, 1].tolist()

        return score

    return load
