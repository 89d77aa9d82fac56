"""Settings of an audit and the fixed values that its results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# Results are defined in terms of these lists and numbers.

URL_FIELDS = ("url", "permalink", "page", "path", "finalUrl", "final_url")
HTML_FIELDS = ("html", "body", "rendered_html")
HTML_COMPLETE_FIELDS = ("html_complete", "htmlComplete", "full_html", "fullHtml", "body_complete", "bodyComplete")
SOURCE_READY_STATUSES = ("collected", "complete", "included", "loaded", "resolved")
EXPECTED_COUNT_ORIGINS = ("AUTO_DERIVED_FROM_PREPARED_UNION", "SYNTHETIC_CONTROL_FIXTURE", "MANIFEST_DECLARED", "NOT_PROVIDED")
NON_PAGE_SUFFIXES = (
    ".7z .avi .css .doc .docx .eot .gif .gz .ico .jpeg .jpg .js .json .map .mov .mp3 .mp4 .mpeg .ogg .otf .pdf .png "
    ".rar .svg .tar .tif .tiff .ttf .wav .webm .webp .woff .woff2 .xls .xlsx .xml .zip"
).split()
STOPWORDS_RU = (
    "а без более бы был была были было быть в вам вас весь во вот все всего вы где да для до его ее если есть еще же за "
    "здесь и из или им их к как когда который ли мы на над не него нее нет но о об один он она они оно от по под при про "
    "с со так также там то того тоже только у уже что чтобы это этот я"
).split()
STOPWORDS_ES = (
    "a al algo ante como con contra cual cuando de del desde donde el ella en entre era es esa ese esta este fue ha hasta "
    "hay la las lo los más muy no o para pero por que qué se sin sobre son su sus también todo un una y"
).split()
STOPWORDS_EN = (
    "a an and are as at be by for from has have how in is it of on or our that the this to was we what when where which "
    "who will with you your"
).split()
GENERIC_ANCHORS = (
    "", "здесь", "подробнее", "читать", "читать далее", "далее", "ссылка", "узнать больше", "aquí", "leer más",
    "más información", "ver más", "enlace", "click here", "here", "read more", "learn more", "more", "this page", "link",
    "continue",
)
LANGUAGE_CODES = "ar bg ca cs da de el en es et fi fr he hi hr hu id it ja ko lt lv nl no pl pt ro ru sk sl sr sv th tr uk vi zh".split()
LANE_PREFIXES = (
    ("/tag/", "taxonomy"), ("/tags/", "taxonomy"), ("/author/", "taxonomy"), ("/category/", "taxonomy"),
    ("/categories/", "taxonomy"), ("/product-category/", "commerce_taxonomy"),
)
NON_CONTENT_LANES = (
    "asset", "attachment", "commerce_taxonomy", "error", "feed", "inventory_only", "legacy_amp", "pagination",
    "redirect", "search", "taxonomy",
)
CONTENT_TYPES = ("post", "page", "article", "guide")
COMMERCE_TYPES = ("product", "listing", "offer")
NON_PUBLIC_STATUSES = ("auto-draft", "draft", "future", "pending", "private", "trash")
SCOPE_WARNING = (
    "Completeness applies only to the operator-declared source scope and supplied evidence; "
    "it is not independent proof that every site source or URL was supplied."
)
EXACT_TOKENS, MINHASH_TOKENS = 40, 80
MINHASH_SIZE, SHINGLE_TOKENS, BANDS = 32, 4, 8
NEAR_DUPLICATE, OVERLAP = 0.82, 0.62
MAX_PAIRS, MAX_OPPORTUNITIES, BEST_SOURCES = 5000, 50, 3
DEEP = 3

STOPWORDS = tuple(dict.fromkeys([*STOPWORDS_RU, *STOPWORDS_ES, *STOPWORDS_EN]))


@dataclass(frozen=True)
class SiteConfig:
    """What one audit is about."""

    site: str
    brand_terms: tuple[str, ...] = ()
    near_duplicate: float = NEAR_DUPLICATE
    overlap: float = OVERLAP
    #: None: all pairs.
    max_pairs: int | None = MAX_PAIRS
    max_opportunities: int = MAX_OPPORTUNITIES
    complete_threshold: float = field(default=1.0)

    def __post_init__(self) -> None:
        if self.complete_threshold != 1.0:
            raise ValueError("complete_threshold must be 1.0: whole-site claims need every active page")
