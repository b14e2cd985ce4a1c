"""Name patterns and rewriting rules that results depend on, in order."""

# A name that holds one of these is left out of the reference graph.
IGNORED_PARTS = (
    "std::",
    "std_",
    "CGReforge",
    "blz::",
    "blz_",
    "CGResearchFrame",
    "TSSimpleArray",
    "CPetBattleScene",
    "MemLineNo",
    "MemFileName",
    "CheckArrayBounds",
    "::CliPut",
    "JamCli",
    "AnimData_",
    "CGTransmogrify",
    "UserRouterClientAuthSession",
    "UserGuildSetGuildMaster",
    "UserClientWorldPortResponse",
    "UserClientSendMail",
    "UserClientDBQueryBulk",
    "UserClientCommentatorStartWargame",
    "MacClient",
    "JamAllAchievements",
    "GlobalGuildDemoteMember",
    "GlobalGuildOfficerRemoveMember",
    "GlobalGuildPromoteMember",
    "GLMipmap",
    "GLFrameSerialization",
    "GLFrameReplayer",
    "GLBatchViewer",
    "GLBatch",
    "ClientRealmResponseAdapter",
    "ClientPhaseShiftChange",
    "CGGlyphInfo",
    "CActor",
    "CActorManager",
    "CActorMapGrid",
    "CActorScene",
    "CActorUnit",
    "CAnimKitManager",
    "CBoneGenerator",
    "CClientLiquidEnvironment",
    "CDataRecycler",
    "CFlyout",
    "CGBlackMarketInfo",
    "CGCUFProfiles",
    "CGEncounterJournal",
    "CGPetBattleInfo",
    "CGSpecializationInfo",
    "CGScenarioPOIFrame",
    "CGVoidStorageInfo",
    "CMinigameTicTacToe_C",
    "CWowMouseMac",
    "CachedFrameBuffer",
    "CliChat",
    "ClientAllAchievementData",
    "ClientBattlefield",
    "ClientClearQuestCompletedBits",
    "ClientGuildRewardList",
    "ClientHotfixNotifyBlob",
    "ClientItemPushResult",
    "ClientLFGJoinResult",
    "ClientLFGUpdateStatus",
    "ClientLFGuildRecruits",
    "ClientLearnedSpells",
    "ClientMapObjEvents",
    "ClientPetBattleFinalRound",
    "ClientPetBattleRoundResult",
    "ClientRaidMarkersChanged",
    "ClientSceneObjectEvent",
    "CliParse",
    "GLCommand",
    "GLLayerMovieFrameSettings",
    "GLObjectManager",
    "GLOcclusionQuery",
    "GLPixelShader",
    "GLRenderbuffer",
    "GLTexture",
    "GLVertexArray",
    "GLVertexShader",
    "GLView",
    "GLWindow",
    "GLWorker",
    "GeneralFunction",
    "GlobalGuild",
    "Mac::",
    "MainApp",
    "PathDB",
    "PlayerBattlefield",
    "PlayerBlackMarketOpen",
    "PlayerCli",
    "PlayerInitiateTrade",
    "PlayerLearnTalents",
    "PlayerMoveWaterWalkAck",
    "PlayerQueryQuestCompletionNPCs",
    "PlayerRequestCategoryCooldowns",
    "PlayerSaveCUFProfiles",
    "PlayerSetSelection",
    "SSAO",
    "UserClientDFSearchJoin",
    "UserClientDFSetRoles",
    "UserClientDFTeleport",
    "UserClientGuildInviteByName",
    "UserClientSetActionButton",
    "UserClientSupportTicketSubmitComplaint",
    "CGPetJournalInfo",
    "CGSceneObject_C",
    "CGSpellActivationOverlay",
    "CScriptActor",
    "CScriptEvent",
    "ChatWindowInfo",
    "ClampCursorInternal",
    "ClientAccountInfoResponse",
    "ClientAllGuildAchievements",
    "ClientBattlePetUpdates",
    "ClientBattlePetXP",
    "ClientBattlegroundPlayerPositions",
    "ClientCategoryCooldown",
    "ClientChallengeModeComplete",
    "ClientEnumCharactersResult",
    "ClientGameEventDebugLog",
    "ClientGuildBankQueryResults",
    "ClientGuildEventLogQueryResults",
    "ClientGuildMoved",
    "ClientGuildRanks",
    "ClientInstanceInfo",
    "ClientLFGuildBrowse",
    "ClientLFGuildPost",
    "ClientMoveSetCompoundState",
    "ClientMoveSplineSetSwimSpeed",
    "ClientPVPLogData",
    "ClientPartyInvite",
    "ClientPetAdded",
    "ClientPetBattleReplacementsMade",
    "ClientQuestCompletionNPCResponse",
    "ClientRequestCemeteryListResponse",
    "ClientResetAreaTrigger",
    "ClientServerPerf",
    "ClientVendorInventory",
    "ClientVoidStorageContents",
    "ClientVoidStorageTransferChanges",
    "GLFence",
    "GLFramebuffer",
    "GLGLSLProgram",
    "GLGenCommandCmdType",
    "GLLayerGameFrame",
    "GLPixelGLSLShader",
    "GLShader",
    "GLShaderCompiler",
    "GLVertexGLSLShader",
    "GameAllocator",
    "JamGuildMemberSetNoteData",
    "JamOfsConst",
    "JamPartyMemberState",
    "JamPetBattleFinalRound",
    "PacketPipe_CliSvr",
    "Physics::",
    "PlayerMoveCharmTeleportCheat",
    "PlayerRequestCemeteryList",
    "PlayerSetDifficultyID",
    "ScriptUtil",
    "JamGuildBankItemInfo",
    "KinematicGroup",
    "HostDebugRepData",
    "GLVariableArray",
    "GLQuickFormat",
    "GLLayerMovieFrame",
    "GLContext",
    "FrameBufferCache",
    "EffectUnconscious",
    "ClientSupercededSpells",
    "ClientStartElapsedTimers",
    "ClientSetupCurrency",
    "ClientDBReply",
    "ClientDumpRideTicketsResponse",
    "ClientGuildAchievementMembers",
    "ClientGuildBankLogQueryResults",
    "ClientGuildBankTextQueryResult",
    "ClientGuildCriteriaUpdate",
    "ClientGuildKnownRecipes",
    "ClientGuildPermissionsQueryResults",
    "ClientInitialSetup",
    "ClientLFGSearchResults",
    "ClientLootItemList",
    "ClientLootResponse",
    "ClientMasterLootCandidateList",
    "ClientMoveSplineDisableCollision",
    "ClientMoveUpdateRemoveMovementForce",
    "ClientPrintNotification",
    "ClientServerInfoResponse",
    "RangedMemManager",
    "GarrisonInfo",
    "GLObjectMule",
    "GGCP",
    "FileNotification",
    "Archaeology",
)

# Rewriting rules in order, (is a regular expression, from, to).
RULES = (
    (False, "__jump_table::_strcasecmp", "SStrCmp"),
    (False, "__jump_table::strchr", "SStrChr"),
    (False, "__jump_table::strcpy", "SStrCopy"),
    (False, "__jump_table::strlen", "SStrLen"),
    (False, "__jump_table::strncasecmp", "SStrCmpI"),
    (False, "__jump_table::strrchr", "SStrChrR"),
    (False, "__jump_table::strstr", "SStrStr"),
    (False, "__jump_table::_gl", "gl"),
    (False, "__jump_table::", ""),
    (False, "_SErr", "SErr"),
    (False, "NTempest::", ""),
    (False, "SE3", "SE2"),
    (False, "SI3", "SI2"),
    (False, "BattlenetUI::Script", "Script"),
    (False, "CGCommentator::Script", "Script"),
    (False, "CWorldMap", "CMap"),
    (False, "WowClientDB2", "WowClientDB"),
    (False, "CUnitDisplay", "CGUnit_C"),
    (False, "::", "__"),
    (False, "_ptr_", "_"),
    (False, "___", "__"),
    (True, r"\b(struct|class)_", ""),
    (True, r"(\w+)<([^,>]+)[^>]*>", "$1__$2"),
    (True, r"(\w+)(.*?)(::|__)\1$", "$1$2$3constructor"),
    (True, r"(\w+)(.*?)(::|__)~\1$", "$1$2$3destructor"),
    (True, r"(\w+)<([^<>,]+)[^<>]*>", "$1__$2"),
    (True, r"(\w+)<([^<>,]+)[^<>]*>", "$1__$2"),
    (False, "TSFixedArray_", "TSGrowableArray_"),
    (False, "`scalar_deleting_destructor'", "destructor"),
    (False, "`vector_deleting_destructor'", "destructor"),
    (False, "__", "_"),
    (False, ">_", "_"),
    (False, "*", ""),
    (False, "_lua", "lua"),
    (False, "unsigned int", "uint32"),
    (False, "unsigned char", "uint8"),
    (False, "signed char", "int8"),
    (False, "unsigned short", "uint16"),
    (False, "signed short", "int16"),
    (False, "signed int", "int32"),
    (False, "unsigned long", "uint64"),
    (False, "signed long", "int64"),
    (False, "long long", "int64"),
    (False, "unsigned long long", "uint64"),
    (False, "unsigned long int", "uint64"),
    (False, "signed long int", "int64"),
    (False, "unsigned long long int", "uint64"),
    (False, "FrameTime_GetCurTimeMs", "OsGetAsyncTimeMs"),
    (False, "FID_conflict:", ""),
    (False, "CMovement_C", "CMovement"),
)

# Operator symbols in the order in which they are tried, and their words.
OPERATORS = (
    ("()", "call"),
    ("*=", "mul_assign"),
    ("+=", "add_on_assign"),
    ("++", "inc"),
    ("<=", "le"),
    ("==", "eq"),
    (">=", "ge"),
    ("!=", "ne"),
    ("<<", "lshift"),
    (">>", "rshift"),
    ("-", "sub"),
    ("*", "mul"),
    ("+", "add"),
    ("<", "lt"),
    (">", "gt"),
    ("=", "assign"),
    ("[]", "subscript"),
)

# Report lines that hold one of these are noise.
NOISE = (
    "__jump",
    "TSList",
    "blz::",
    "MacClient",
    "TSCGrowableArray",
    "JamCli",
    "WowClientDB",
    "System_",
    "JamGuildNewsEvent",
    "DBCache",
    "MpqSystemList",
    "ComSat",
    "CWowMouseMac",
    "TSGrowableArray",
    "Crypt",
    "CDataStore",
    "CGBlobFrame",
    "WoWReport",
    "TSFixedArray",
    "MusicPlayerInterface",
    "GLShaderCompiler",
    "WDataStore",
    "TSHashTable",
    "CGxDevice",
    "FMOD",
    "BSN::",
    "std::",
    "FUN_",
    " _",
    "ProtocolHard",
    "Blizzard",
    "Battlenet",
    "CAnimKitManager",
)
