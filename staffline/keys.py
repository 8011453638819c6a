"""Names and fixed sizes shared by every operator.

A bar is keyed by (song_id, track_idx, bar_index). The track index keeps two
tracks of one instrument apart, which a display id made of song, instrument and
bar number does not.
"""

BAR = ("song_id", "track_idx", "bar_index")
TRACK = ("song_id", "track_idx")

# The grid of a 4/4 bar and the MIDI ranges.
STEPS_PER_BEAT = 24
STEPS = 96
PITCHES = 128
VELOCITY_MAX = 127

# Positional names of the five-track layout.
INSTRUMENTS = ("drums", "piano", "guitar", "bass", "strings")
