"""The question-answering plan: one retrieval feeds every later step, for any number of questions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import answers, lexical, search

# Templates are text with the places {context} and {question}, by language and name; the wording is our own.
_ASKED = {"en": "Context:\n{context}\n\nQuestion: {question}\n\nAnswer:", "vi": "Ngữ cảnh:\n{context}\n\nCâu hỏi: {question}\n\nTrả lời:"}
_RULES = {
    "en": {
        "basic_qa": "Use only the context below. If it does not hold the answer, say so.",
        "audio_qa": "The context is a transcript with times. Give the time [MM:SS] of what you use.",
        "factual_qa": "State facts from the context only, briefly and exactly, with figures as written.",
        "cot_qa": "Go through the context step by step, say which parts bear on the question, then conclude.",
        "strict_qa": "Answer from the context alone. If it does not hold the answer, say that there is no information. Do not guess.",
        "citation_required": "Put the number of the source, as [1], after every statement. Leave out statements without a source.",
        "conflict_aware": "Sources may disagree. Name each version with its source and date, and say which is the newest.",
        "safe_abstention": "Judge first whether the context is enough. If it is not, say what is missing instead of answering.",
    },
    "vi": {
        "basic_qa": "Chỉ dùng ngữ cảnh dưới đây. Nếu không có câu trả lời, hãy nói rõ.",
        "audio_qa": "Ngữ cảnh là bản ghi có mốc thời gian. Nêu mốc [MM:SS] của phần được dùng.",
        "factual_qa": "Chỉ nêu dữ kiện có trong ngữ cảnh, ngắn gọn, giữ nguyên số liệu.",
        "cot_qa": "Xét từng phần của ngữ cảnh, nêu phần liên quan rồi kết luận.",
        "strict_qa": "Chỉ trả lời từ ngữ cảnh. Nếu không có, hãy nói là không có thông tin. Không suy đoán.",
        "citation_required": "Ghi số nguồn, như [1], sau mỗi ý. Bỏ ý không có nguồn.",
        "conflict_aware": "Các nguồn có thể mâu thuẫn. Nêu từng phiên bản với nguồn và ngày, và cho biết bản mới nhất.",
        "version_compare": "So sánh các phiên bản trong ngữ cảnh theo thời gian: điểm giống, điểm khác, bản đang có hiệu lực.",
        "safe_abstention": "Trước hết xét ngữ cảnh có đủ không. Nếu không đủ, nêu phần còn thiếu thay vì trả lời.",
    },
}
TEMPLATES = {(lang, name): f"{rule}\n\n{_ASKED[lang]}" for lang, rules in _RULES.items() for name, rule in rules.items()}


def add_template(name: str, text: str, language: str = "en") -> None:
    TEMPLATES[language, name] = text


def template_names(language: str = "en") -> list[str]:
    return [name for lang, name in TEMPLATES if lang == language]


def prompt(template: str, context, question, language: str = "en"):
    """The prompt column; an unknown name gives the language's basic_qa."""
    t = F.lit(TEMPLATES.get((language, template), TEMPLATES[language, "basic_qa"]))
    return F.replace(F.replace(t, F.lit("{context}"), context), F.lit("{question}"), question)


def retrieve(docs: DataFrame, questions: DataFrame, k: int = 5, alpha: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hybrid hits (query_id, id, score, rank) of all questions (query_id, question)."""
    near = search.knn(search.embed(docs.select(id_col, text_col), text_col), search.embed(questions, "question"), 2 * k, id_col=id_col, query_id="query_id")
    terms = lexical.query_terms(questions, "query_id", "question")
    return search.hybrid(near, lexical.bm25_scores(*lexical.query_index(docs, terms, id_col, text_col), terms), k, alpha)


def answer(docs: DataFrame, questions: DataFrame, k: int = 5, alpha: float = 0.7, budget: int = 1000, template: str = "basic_qa", least: float = 0.3, generator=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, context, prompt, answer, abstain, reason, n_claims, coverage, confidence, level, action).

    Retrieve, abstain early where hits are weak, compress, build the context, answer by extraction (the best
    sentences; a generator provider takes the prompt instead), verify the answer against the context it was made from.
    """
    hits = retrieve(docs, questions, k, alpha, id_col, text_col)
    pairs = hits.join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").join(questions.select("query_id", F.col("question").alias("query")), "query_id")
    small = answers.extractive_compress(pairs, keys=("query_id", "id", "rank"))
    context = answers.context_budget(small, budget, text_col="compressed")
    said = small.filter("rank = 1").select("query_id", F.col("compressed").alias("answer"))
    quality = answers.retrieval_quality(hits)
    state = answers.abstention(questions, hits, least)
    rows = questions.select("query_id", "question").join(context, "query_id", "left").join(said, "query_id", "left").join(quality, "query_id", "left").join(state.select("query_id", "abstain", "reason"), "query_id", "left")
    rows = rows.withColumns({"context": F.coalesce("context", F.lit("")), "answer": F.when(F.col("abstain"), "There is no information on this: not found.").otherwise(F.coalesce("answer", F.lit("")))})
    rows = rows.withColumn("prompt", prompt(template, F.col("context"), F.col("question")))
    if generator is not None:
        rows = rows.withColumn("answer", F.when(F.col("abstain"), F.col("answer")).otherwise(generated(F.col("prompt"), generator)))
    return answers.verify(rows, retrieval=F.coalesce("quality", F.lit(0.5)), keys=("query_id", "context", "prompt", "answer", "abstain", "reason"))


def generated(prompts, generator):
    """Answers of a generator provider on Arrow batches; what it raises becomes the answer's text."""
    def one(p: str) -> str:
        try:
            return generator.answer(p)
        except Exception as x:  # noqa: BLE001
            return f"Error: {x}"

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(one)

    return run(prompts)


def retrieve_and_compress(docs: DataFrame, questions: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, rank, compressed, ...): 2k hits, compressed, of which the first k with anything left stay."""
    hits = retrieve(docs, questions, 2 * k, id_col=id_col, text_col=text_col)
    pairs = hits.join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").join(questions.select("query_id", F.col("question").alias("query")), "query_id")
    small = answers.extractive_compress(pairs, keys=("query_id", "id", "rank"))
    return lexical.top_k(small.withColumn("order", -F.col("rank")).drop("rank"), k, "order").drop("order")


def multi_query(docs: DataFrame, questions: DataFrame, k: int = 5, expansions: int = 3, fusion: str = "rrf", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each question's variants are searched as questions of their own, 2k hits each, then fused to k."""
    v = lexical.expand_synonyms(questions, "query_id", "question", expansions).withColumn("list_id", F.xxhash64(F.col("query_id").cast("string"), "position"))
    hits = retrieve(docs, v.select(F.col("list_id").alias("query_id"), F.col("variant").alias("question")), 2 * k, id_col=id_col, text_col=text_col)
    lists = hits.withColumnRenamed("query_id", "list_id").join(v.select("query_id", "list_id"), "list_id").select("query_id", "list_id", "id", "score", "rank")
    return search.reciprocal_rank_fusion(lists, k) if fusion == "rrf" else search.score_fusion(lists, k)
