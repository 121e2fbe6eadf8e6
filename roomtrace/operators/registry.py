"""Named operations on tables, for callers that pick one by name."""

from roomtrace.operators import bookings, conversation, evaluate, listings, search, traces

OPERATORS = {
    f.__name__: f
    for f in [
        listings.normalize, listings.dedup_by_link, listings.latest_by_id, listings.load_listings,
        listings.listing_count, listings.profile, listings.filter_listings, listings.order_by_recency,
        listings.search, listings.get_listing,
        search.validate_search, search.search_batch, search.render_search, search.details_batch,
        search.render_details,
        bookings.free_slots, bookings.slots_batch, bookings.adjudicate, bookings.accepted,
        bookings.render_slots, bookings.render_bookings,
        conversation.session_segments, conversation.intent_in_context, conversation.intent_of_steps, conversation.prompt_of_steps, conversation.history_block,
        conversation.assemble_prompts,
        traces.resolve_attempts, traces.parse_steps, traces.classify_calls, traces.classify_steps,
        traces.summarize_traces, traces.transcript_at,
        evaluate.check_tool_path, evaluate.check_grounding, evaluate.find_repeated_actions,
        evaluate.check_slot_before_book, evaluate.flag_fabricated, evaluate.check_baseline,
    ]
}
