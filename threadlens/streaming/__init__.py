from .stateless import run_available_now, stream_head_scores, stream_text_features  # noqa: F401
