"""The application's tables: schemas, keys, references and the endpoints' rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .operators.deletes import Edge
from .operators.inserts import Unique

# Fixed value: what a text column without a length holds.
TEXT_BYTES = 65_535

INT, TEXT, TIME = T.IntegerType(), T.StringType(), T.TimestampNTZType()


@dataclass(frozen=True)
class Table:
    """Fixed values of one table. Lists name columns; `lengths` are in characters.

    Text columns without a length hold TEXT_BYTES bytes.
    """

    name: str
    key: str
    schema: T.StructType
    lengths: dict[str, int]
    read: tuple[str, ...]
    create: tuple[str, ...]
    patch: tuple[str, ...] = ()
    unique: Unique | None = None
    conflict_on_patch: str | None = None
    references: tuple[str, ...] = ()
    stamps: tuple[str, ...] = ()
    touch: str | None = None
    newest_first: bool = False
    filter_by: str | None = None
    ranges: tuple[tuple[str, int, int], ...] = ()
    owned: bool = False
    null_code: int = 409
    missing: str = "not found"
    lookups: bool = True
    deletes: bool = False

    @property
    def texts(self) -> tuple[str, ...]:
        return tuple(
            f.name for f in self.schema.fields if f.dataType == TEXT and f.name not in self.lengths
        )

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.schema.fields if not f.nullable)


def _schema(**columns: tuple[T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, (t, null) in columns.items()])


MEMBER = Table(
    name="member",
    key="member_id",
    schema=_schema(
        member_id=(INT, False),
        email=(TEXT, False),
        password=(TEXT, False),
        nickname=(TEXT, False),
        gender=(TEXT, True),
        country=(TEXT, True),
        create_member=(TIME, False),
        modify_member=(TIME, False),
    ),
    lengths={"email": 255, "password": 255, "nickname": 50, "gender": 10, "country": 50},
    read=(
        "member_id", "email", "nickname", "gender", "country", "create_member",
        "modify_member",
    ),
    create=("email", "password", "nickname", "gender", "country"),
    patch=("email", "password", "nickname", "gender", "country"),
    unique=Unique(("email",), ("email",), "Email already exists"),
    stamps=("create_member", "modify_member"),
    touch="modify_member",
    owned=True,
    missing="Member not found",
)

RESTRICTION_CATEGORY = Table(
    name="restriction_category",
    key="category_id",
    schema=_schema(
        category_id=(INT, False),
        category_label_ko=(TEXT, False),
        category_label_en=(TEXT, False),
    ),
    lengths={"category_label_ko": 50, "category_label_en": 50},
    read=("category_id", "category_label_ko", "category_label_en"),
    create=("category_label_ko", "category_label_en"),
    patch=("category_label_ko", "category_label_en"),
    unique=Unique(
        ("category_label_en",), ("category_label_en",), "Category label_en already exists"
    ),
    missing="Category not found",
)

RESTRICTION_ITEMS = Table(
    name="restriction_items",
    key="item_id",
    schema=_schema(
        item_id=(INT, False),
        item_label_ko=(TEXT, False),
        item_label_en=(TEXT, False),
        category_id=(INT, False),
    ),
    lengths={"item_label_ko": 100, "item_label_en": 100},
    read=("item_id", "item_label_ko", "item_label_en", "category_id"),
    create=("item_label_ko", "item_label_en", "category_id"),
    patch=("item_label_ko", "item_label_en", "category_id"),
    unique=Unique(("item_label_en",), ("item_label_en",), "Item label_en already exists"),
    conflict_on_patch="Item code already exists",
    references=("category_id",),
    filter_by="category_id",
    missing="Item not found",
)

MEMBER_RESTRICTIONS = Table(
    name="member_restrictions",
    key="member_restrictions_id",
    schema=_schema(
        member_restrictions_id=(INT, False),
        item_id=(INT, False),
        member_id=(INT, False),
    ),
    lengths={},
    read=("member_restrictions_id", "member_id", "item_id"),
    create=("member_id", "item_id"),
    unique=Unique(("member_id", "item_id"), (), "Already assigned (member_id, item_id)"),
    references=("member_id", "item_id"),
    filter_by="member_id",
    missing="Member restriction not found",
    lookups=False,
    deletes=True,
)

REVIEW = Table(
    name="review",
    key="review_id",
    schema=_schema(
        review_id=(INT, False),
        review_title=(TEXT, False),
        review_content=(TEXT, False),
        rating=(INT, True),
        location=(TEXT, True),
        create_review=(TIME, False),
        member_id=(INT, False),
    ),
    lengths={"location": 100},
    read=(
        "review_id", "review_title", "review_content", "rating", "location",
        "create_review", "member_id",
    ),
    create=("review_title", "review_content", "rating", "location", "member_id"),
    patch=("review_title", "review_content", "rating", "location", "member_id"),
    references=("member_id",),
    stamps=("create_review",),
    newest_first=True,
    filter_by="member_id",
    ranges=(("rating", 1, 5),),
    null_code=500,
    missing="Review not found",
    deletes=True,
)

COMMUNITY = Table(
    name="community",
    key="community_id",
    schema=_schema(
        community_id=(INT, False),
        field=(TEXT, True),
        member_id=(INT, False),
    ),
    lengths={},
    read=("community_id", "field", "member_id"),
    create=("field", "member_id"),
    references=("member_id",),
    newest_first=True,
    filter_by="member_id",
    missing="Community not found",
    deletes=True,
)

TABLES = {
    t.name: t
    for t in (
        MEMBER, RESTRICTION_CATEGORY, RESTRICTION_ITEMS, MEMBER_RESTRICTIONS, REVIEW,
        COMMUNITY,
    )
}

# Which table a reference column points to; the column has the parent key's name.
PARENT_OF = {
    "member_id": "member",
    "item_id": "restriction_items",
    "category_id": "restriction_category",
}

EDGES = (
    Edge("restriction_items", "category_id", "restriction_category", "category_id", "restrict"),
    Edge("member_restrictions", "item_id", "restriction_items", "item_id"),
    Edge("member_restrictions", "member_id", "member", "member_id"),
    Edge("review", "member_id", "member", "member_id"),
    Edge("community", "member_id", "member", "member_id"),
)
