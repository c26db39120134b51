"""Asset and media classification of serialised URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import urls as U
from pagequarry.functions.text import bind, ci, matches


def asset_class(u: Column, mime: Column) -> Column:
    """images, videos, audio, styles, scripts, fonts, documents or other."""
    chain = F
    for name, ext, mime_pattern in fv.ASSET_CLASSES:
        chain = chain.when(matches(u, ext) | matches(mime, mime_pattern), name)
    return chain.otherwise("other")


def provider(u: Column) -> Column:
    """Known player host, NULL otherwise."""

    def named(h: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, exact, suffixes in reversed(fv.MEDIA_PROVIDERS):
            tests = [h == e for e in exact] + [h.endswith(s) for s in suffixes]
            out = F.when(reduce(lambda a, b: a | b, tests), name).otherwise(out)
        return out

    return bind(U.site(u), named)


def media_kind(u: Column, hint: Column, player: Column) -> Column:
    """video_embed, video, audio, image, document or link."""
    both = F.concat(F.lower(u), F.lit(" "), F.lower(hint))
    return (
        F.when(player.isNotNull(), "video_embed")
        .when(matches(u, fv.MEDIA_VIDEO_EXT) | matches(both, r"\bvideo/") | matches(hint, fv.MEDIA_VIDEO_HINT), "video")
        .when(matches(u, fv.MEDIA_AUDIO_EXT) | matches(both, r"\baudio/"), "audio")
        .when(matches(u, fv.MEDIA_IMAGE_EXT) | matches(both, r"\bimage/"), "image")
        .when(matches(u, fv.MEDIA_DOCUMENT_EXT) | matches(both, fv.MEDIA_DOCUMENT_HINT), "document")
        .otherwise("link")
    )


def is_downloadable(u: Column, kind: Column) -> Column:
    return F.when(kind == "video", ~matches(u, fv.MEDIA_STREAM_EXT)).otherwise(
        kind.isin("audio", "image", "document")
    )


def is_media_noise(u: Column, context: Column) -> Column:
    return matches(F.concat(u, F.lit(" "), context), fv.MEDIA_NOISE)


def _decoded_path(u: Column) -> Column:
    return F.lower(U.decode_component(U.path(u)))


def is_gallery_control(u: Column) -> Column:
    """Lightbox buttons and page chrome: never album images."""

    def control(p: Column) -> Column:
        name = U.base_name(p)
        return (
            name.rlike(fv.GALLERY_CONTROL_FILE)
            | name.rlike(fv.GALLERY_CHROME_FILE)
            | (p.rlike(fv.GALLERY_WIDGET_PATH) & name.rlike(fv.GALLERY_WIDGET_FILE))
        )

    return bind(_decoded_path(u), control)


def is_template_asset(u: Column, context: Column) -> Column:
    return bind(
        _decoded_path(u),
        lambda p: matches(p, fv.GALLERY_TEMPLATE)
        | matches(F.concat(p, F.lit(" "), F.lower(context)), fv.GALLERY_TEMPLATE_WORDS),
    )


def gallery_score(u: Column, context: Column, via: Column) -> Column:
    """Evidence that an image belongs to the album shown on the page."""
    w = fv.GALLERY_SCORES

    def score(p: Column) -> Column:
        hay = F.concat_ws(" ", p, F.lower(context), F.lower(via))
        in_path, in_context = matches(p, fv.GALLERY_PATH), matches(hay, fv.GALLERY_CONTEXT)
        file_like = matches(p, fv.GALLERY_FILE_LIKE)
        template = is_template_asset(u, context) & ~in_path & ~in_context & ~file_like
        terms = [
            (template, w["template"]), (in_path, w["path"]), (in_context, w["context"]), (file_like, w["file_like"]),
            (matches(hay, "(?:original|large|full|zoom)"), w["full_size"]),
            (matches(hay, "(?:thumb|thumbnail|small|icon)"), w["thumb"]),
            (via == "href", w["href"]), (matches(p, fv.GALLERY_IMAGE_EXT), w["extension"]),
        ]
        return reduce(lambda a, b: a + b, [F.when(test, points).otherwise(0) for test, points in terms])

    return bind(_decoded_path(u), score)


def has_extension(u: Column, pattern: str) -> Column:
    """The extension pattern fits the path or a parameter value."""
    values = F.transform(U.param_pairs(u), lambda p: p["value"])
    return matches(U.path(u), pattern) | F.exists(values, lambda v: v.rlike(ci(pattern)))


def is_directory(u: Column) -> Column:
    """Ends in '/', no query, no file extension: a listing, not a file."""
    return U.path(u).endswith("/") & (U.search(u) == "") & ~has_extension(u, fv.ANY_EXT) & U.scheme(u).isin("http", "https")


def is_document(u: Column) -> Column:
    return (
        U.scheme(u).isin("http", "https")
        & ~is_directory(u)
        & (matches(U.path(u), fv.DOCUMENT_PATH) | has_extension(u, fv.DOCUMENT_EXT))
    )


def is_content_image(u: Column) -> Column:
    name = F.lower(U.base_name(U.path(u)))
    return (
        U.scheme(u).isin("http", "https")
        & matches(name, fv.CONTENT_IMAGE_EXT)
        & ~matches(name, fv.CONTENT_IMAGE_NOISE)
        & matches(U.path(u), fv.CONTENT_IMAGE_PATH)
    )
