"""Options and label sets; defaults are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Entity types by task.
TASKS = {
    "ncbi": ("Disease",),
    "conll03": ("LOC", "PER", "ORG", "MISC"),
    "bc2gm": ("GENE",),
    "ontonotes": ("CARDINAL", "DATE", "EVENT", "FAC", "GPE", "LANGUAGE", "LAW", "LOC", "MONEY", "NORP", "ORDINAL", "ORG", "PERCENT", "PERSON", "PRODUCT", "QUANTITY", "TIME", "WORK_OF_ART"),
    "tweetner7": ("corporation", "creative_work", "event", "group", "location", "person", "product"),
}
#: What the prompts of a task say about its types.
GUIDES = {
    "ncbi": "Text: abstracts of medical articles. Disease covers single diseases, classes of diseases, syndromes, and abbreviations of any of them, also where they qualify another noun.",
    "conll03": "Text: news. LOC: places on a map. PER: people, real or invented. ORG: companies, bodies, teams and parties. MISC: other proper names such as nationalities, events and works.",
    "bc2gm": "Text: sentences of biomedical articles. GENE covers genes, proteins, their families, complexes and mutants, with the words that belong to their names.",
    "ontonotes": "Text: news, talk and web pages. GPE: places with a government. LOC: other places. FAC: what people built. NORP: nationalities, religions, political groups. WORK_OF_ART: titles. LAW: named documents with legal force. "
    "DATE is a day or longer, TIME is shorter. MONEY, PERCENT and QUANTITY include their unit; ORDINAL and CARDINAL are the other numbers. EVENT, LANGUAGE, ORG, PERSON and PRODUCT are proper names.",
    "tweetner7": "Text: short public posts, with hashtags and account names. corporation: businesses. group: bands, teams, parties and other bodies. creative_work: titles. event: named happenings. location: places. person: people. product: named goods, services and brands.",
}
#: English function words that never count as evidence.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves s t d ll m o re ve y don ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn".split()
)
ARTICLES = ("a", "an", "the")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
RARE = 5


@dataclass(frozen=True)
class Options:
    task: str = "conll03"
    context_len: int = 2
    demo_num: int = 8
    span_demo_num: int = 4
    retrieval: str = "dense"  # dense, blended or random
    alpha_token_match: float = 1.0
    alpha_embed_sim: float = 1.0
    entity_weight: float = 1.0
    context_weight: float = 1.0
    other_weight: float = 0.01
    entity_bound_unseen: float = 0.5
    context_bound_unseen: float = 0.5
    entity_bound_fn: float = 0.95
    process_abbrev: str = "none"  # none, only or unseen
    ignore_rare: bool = False
    ignore_article: bool = False
    include_unseen_boundary: bool = False
    filter_single_token_fp: bool = False
    train_num: int | None = None
    eval_num: int | None = None
    sample_seed: int = 42
    template: str = "icl_json"
    extra: dict = field(default_factory=dict)

    @property
    def types(self) -> tuple[str, ...]:
        return TASKS[self.task]

    @property
    def guide(self) -> str:
        return GUIDES[self.task]


#: Options that each task is run with.
PRESETS = {
    "ncbi": Options("ncbi", span_demo_num=1, entity_bound_unseen=0.75, context_bound_unseen=0.75, process_abbrev="unseen", filter_single_token_fp=True),
    "conll03": Options("conll03", span_demo_num=1, alpha_token_match=0.01, entity_bound_fn=0.9, process_abbrev="only", filter_single_token_fp=True),
    "bc2gm": Options("bc2gm", span_demo_num=1, alpha_embed_sim=0.01, context_weight=0.5, entity_bound_fn=0.9, process_abbrev="only", filter_single_token_fp=True),
    "ontonotes": Options("ontonotes", entity_bound_unseen=0.9, context_bound_unseen=0.9, ignore_rare=True, ignore_article=True),
    "tweetner7": Options("tweetner7", span_demo_num=1, entity_bound_unseen=0.75, context_bound_unseen=0.75),
}
